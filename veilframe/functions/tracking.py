"""One video's box tracks: constant-velocity prediction, greedy IoU matching."""
from __future__ import annotations

from veilframe import catalogue as C

# A track is [id, x1, y1, x2, y2, vx1, vy1, vx2, vy2, missed, type, authorised].
Track = list


def overlap_share(a: list, b: list) -> float:
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / joint if joint > 0 else 0.0


def predict(tracks: list[Track]) -> None:
    """Move every track by its velocity and count the frame as missed."""
    for t in tracks:
        for i in range(1, 5):
            t[i] += t[i + 4]
        t[9] += 1


def update(tracks: list[Track], found: list[tuple], next_id: int) -> tuple[list[Track], int]:
    """Match detections (x1, y1, x2, y2, type, authorised) in order; start and
    end tracks. A track that was authorised once stays so."""
    predict(tracks)
    free = list(tracks)
    fresh = []
    for *box, kind, known in found:
        best, share = None, C.TRACK_IOU
        for t in free:
            now = overlap_share(box, t[1:5])
            if now > share:
                best, share = t, now
        if best is None:
            fresh.append([next_id, *map(float, box), 0.0, 0.0, 0.0, 0.0, 0, kind, bool(known)])
            next_id += 1
            continue
        # Matched by identity: two tracks may hold equal values.
        free = [t for t in free if t is not best]
        for i, value in enumerate(box, 1):
            best[i + 4] = (1 - C.TRACK_VELOCITY) * best[i + 4] + C.TRACK_VELOCITY * (value - best[i])
            best[i] = float(value)
        best[9], best[10], best[11] = 0, kind, best[11] or bool(known)
    alive = [t for t in tracks if t[9] <= C.TRACK_MAX_MISSED]
    return alive + fresh, next_id


def rows(tracks: list[Track], *head) -> list[tuple]:
    return [(*head, t[0], *[int(v) for v in t[1:5]], t[10], t[11]) for t in tracks]
