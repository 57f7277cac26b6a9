"""Order-dependent operators against plain loops on random pages."""
import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import fuzzy
from veilframe.functions.scan import exclusive_scan, islands
from veilframe.operators import audio, boxes, tokens, video

WORDS = ["ASHA", "PATIL", "Asha", "name", "NAME", "of", "Ravi", "x1", "KUMAR", "SHAH", "JOSHI", "42", "Road", "ROAD", "MEHTA", "asha"]
DET = ("doc_id bigint, page_no int, det_no bigint, word string, x0 int, y0 int, x1 int, y1 int, label string, pattern string, "
       "priority int, score double")
TOK = "doc_id bigint, page_no int, pos bigint, text string, left_x int, top int, width int, height int, conf int"


def iou(a, b):
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / joint if joint > 0 else 0.0


@pytest.fixture(scope="module")
def page_dets():
    rng, rows = random.Random(7), []
    for i in range(400):
        # Page 1 of document 1 holds most rows, many of them near copies.
        doc = 1 if i % 4 else rng.randrange(2, 5)
        x, y = rng.randrange(0, 300), rng.choice([20, 24, 60, 66, 90, 130, 300]) + rng.randrange(0, 4)
        w, h = rng.randrange(20, 80), rng.randrange(15, 25)
        word = rng.choice(["asha patil", "asha patel", "ravi", "ABCPK1234Z", ""])
        rows.append((doc, 1, i, word, x, y, x + w, y + h, "B-PER", None, rng.choice([40, 75, 90]), None))
        if i % 5 == 0:
            rows.append((doc, 1, 1000 + i, word, x + rng.randrange(0, 3), y, x + w, y + h, "B-PER", "P", 75, 0.5))
    return rows


def pages(rows):
    out = {}
    for r in rows:
        out.setdefault(r[:2], []).append(r)
    return out


def strict(rows, min_iou, least, order):
    kept = []
    for r in sorted(rows, key=order):
        look = r[3].strip().lower()
        if not any(iou(r[4:8], k[4:8]) > min_iou and fuzzy.ratio(look, k[3].strip().lower()) > least for k in kept):
            kept.append(r)
    return kept


def test_strict_duplicates(spark, page_dets):
    got = boxes.drop_similar_strict(spark.createDataFrame(page_dets, DET))
    want = {r[2] for rows in pages(page_dets).values() for r in strict(rows, 0.85, 90, lambda r: (-r[10], r[2]))}
    assert {r.det_no for r in got.collect()} == want and len(want) < len(page_dets)


def plain_merge(dets):
    want = []
    for key, rows in pages(dets).items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r[10], r[2])):
            box, word = list(r[4:8]), r[3].strip().lower()
            for k in kept:
                have, said = k["box"], k["word"].strip().lower()
                if iou(box, have) > 0.6 and fuzzy.ratio(word, said) > 85:
                    break
                if abs(box[1] - have[1]) < 15 and min(abs(box[2] - have[0]), abs(have[2] - box[0])) < 20:
                    k["box"] = [min(box[0], have[0]), min(box[1], have[1]), max(box[2], have[2]), max(box[3], have[3])]
                    k["word"] = said + " " + word
                    break
            else:
                kept.append({"box": box, "word": r[3], "no": r[2]})
        want += [(*key, k["no"], k["word"], *k["box"]) for k in kept]
    return sorted(want)


def merged(spark, rows):
    return sorted(tuple(r)[:8] for r in boxes.merge_by_priority(spark.createDataFrame(rows, DET)).collect())


def test_priority_merge(spark, page_dets):
    assert merged(spark, page_dets) == plain_merge(page_dets)


@pytest.mark.parametrize("large", [1, 40, 4096])
def test_priority_merge_of_any_boxes(spark, monkeypatch, large):
    """Dense, wide, empty and turned boxes, negative places, equal ranks; split as deep as it goes."""
    monkeypatch.setattr(boxes, "LARGE_BLOCK", large)
    rng, rows = random.Random(3), []
    for i in range(900):
        x, y = rng.randrange(-300, 2400), rng.randrange(-200, 3200)
        w = rng.choice([0, 30, 60, 90, 90, 400, 2500 if i % 60 == 0 else 20]) * rng.choice([1, 1, 1, -1])
        h = rng.choice([0, 12, 20, 60, 3000 if i % 90 == 0 else 15]) * rng.choice([1, 1, -1])
        rows.append((1, rng.choice([1, 1, 1, 2]), i, rng.choice(["ravi", "asha patil", "", None]) or "", x, y, x + w, y + h, "B-PER", None,
                     rng.choice([40, 75, 90]), None))
    want = plain_merge(rows)
    assert len(want) < len(rows)
    assert merged(spark, rows) == want


def nest(x, y, side, depth):
    """Boxes around the four sides of a square like sails, another square inside: each level opens only when cut from outside."""
    if depth == 0:
        return [(x, y, x + side, y + side)]
    t = side // 4
    ring = [(x, y, x + side, y + t), (x, y + t + 40, x + t, y + side)]
    return ring + nest(x + t + 60, y + t + 40, side - t - 60, depth - 1)


def test_blocks_open_level_by_level(spark, monkeypatch):
    rows = [(1, 1, i, "w", *box, "B-PER", None, 75, None) for i, box in enumerate(nest(0, 0, 4000, 4))]
    dets = spark.createDataFrame(rows, DET)
    count = lambda: boxes.merge_blocks(dets).select("block").distinct().count()
    coarse = count()
    monkeypatch.setattr(boxes, "LARGE_BLOCK", 1)
    assert coarse < count() == len(rows)
    assert merged(spark, rows) == plain_merge(rows)


def test_a_page_that_never_falls_apart(spark):
    """Bricks: no blank row or column crosses them, nothing merges, and 40 000 take seconds."""
    import time
    rows = spark.range(40_000).selectExpr(
        "1L doc_id", "1 page_no", "id det_no", "concat('w', id) word", "cast((id % 200) * 100 + (id div 200) % 2 * 50 as int) x0",
        "cast((id div 200) * 16 as int) y0", "cast((id % 200) * 100 + (id div 200) % 2 * 50 + 75 as int) x1",
        "cast((id div 200) * 16 + 20 as int) y1", "'B-PER' label", "cast(null as string) pattern", "75 priority", "cast(null as double) score")
    began = time.time()
    got = boxes.merge_by_priority(rows)
    assert got.agg({"n_merged": "sum"}).first()[0] == 40_000 == got.count()
    assert time.time() - began < 60


def test_chain_merge(spark, page_dets):
    want = []
    for key, rows in pages(page_dets).items():
        merged = []
        for r in sorted(rows, key=lambda r: (r[5], r[4], r[2])):
            box = list(r[4:8])
            if merged:
                last = merged[-1]
                if min(last[1][2], box[2]) > max(last[1][0], box[0]) and min(last[1][3], box[3]) > max(last[1][1], box[1]):
                    last[0].append(r[3])
                    last[1] = [min(last[1][0], box[0]), min(last[1][1], box[1]), max(last[1][2], box[2]), max(last[1][3], box[3])]
                    continue
            merged.append([[r[3]], box])
        want += [(*key, " ".join(m[0]), *m[1]) for m in merged]
    got = boxes.merge_chain(spark.createDataFrame(page_dets, DET)).select("doc_id", "page_no", "word", "x0", "y0", "x1", "y1").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.fixture(scope="module")
def page_tokens():
    rng, rows = random.Random(11), []
    for doc, n in ((1, 600), (2, 60), (3, 9)):
        pos = 0
        for i in range(n):
            pos += rng.choice([1, 1, 1, 3])
            text = rng.choice(WORDS)
            rows.append((doc, 1, pos, text, 60 + (i % 8) * 95 + rng.randrange(0, 9), 40 + (i // 8) * 30 + rng.randrange(0, 7),
                         rng.randrange(40, 90), 20, rng.randrange(50, 99)))
    return rows


def test_line_merge(spark, page_tokens):
    for variant in ("v0", "v1"):
        want = []
        for key, rows in pages(page_tokens).items():
            cur, out = None, []
            for r in sorted(rows, key=lambda r: (r[5], r[4], r[2])):
                _, _, pos, text, left, top, width, height, _ = r
                if cur:
                    gap = left - (cur[2] + cur[4])
                    fits = gap <= max(20, int(.2 * width)) if variant == "v0" else (
                        0 <= gap <= max(15, int(.15 * width)) and len(cur[1].split()) < 5)
                    if abs(top - cur[3]) <= max(8, int(.02 * height)) and fits:
                        cur = (cur[0], cur[1] + " " + text, cur[2], cur[3], left + width - cur[2])
                        continue
                    out.append(cur)
                cur = (pos, text, left, top, width)
            out.append(cur)
            want += [(*key, *c) for c in out]
        got = tokens.merge_lines(spark.createDataFrame(page_tokens, TOK), variant).select(
            "doc_id", "page_no", "pos", "text", "left_x", "top", "width").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_upper_names(spark, page_tokens):
    want = []
    for key, rows in pages(page_tokens).items():
        rows = sorted(rows, key=lambda r: r[2])
        fits = [r[3].isupper() and r[3].isalpha() and r[3] not in C.NAME_STOPWORDS for r in rows]
        i = 0
        while i < len(rows):
            n = 0
            if fits[i] and len(rows[i][3]) >= 3 and rows[i][5] <= 3300 * .75:
                n = 1
                while n < 5 and i + n < len(rows) and fits[i + n] and abs(rows[i + n][5] - rows[i][5]) < 15:
                    n += 1
            if 2 <= n <= 4:
                used = rows[i:i + n]
                name = " ".join(r[3] for r in used)
                w = max(r[4] + r[6] for r in used) - min(r[4] for r in used)
                if len(name) <= 40 and w <= 800:
                    want.append((*key, i, name))
                i += n
            else:
                i += 1
    got = tokens.upper_names(spark.createDataFrame(page_tokens, TOK)).select("doc_id", "page_no", "idx", "word").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_token_duplicates(spark, page_tokens):
    rows = page_tokens + [(*r[:2], r[2] + 10**6, r[3], r[4] + 1, *r[5:8], r[8] - 1) for r in page_tokens]
    got = boxes.drop_similar_tokens(spark.createDataFrame(rows, TOK)).collect()
    flat = [(*r[:4], r[4], r[5], r[4] + r[6], r[5] + r[7], "", None, r[8]) for r in rows]
    want = {(r[0], r[2]) for page in pages(flat).values() for r in strict(page, 0.7, 80, lambda r: (-r[10], r[2]))}
    assert {(r.doc_id, r.pos) for r in got} == want and len(want) < len(rows)


@pytest.fixture(scope="module")
def frame_dets():
    rng, rows, n = random.Random(3), [], 0
    for vid in (1, 2):
        for frame in range(0, 61):
            if frame in (20, 35, 36) or (vid == 2 and 40 <= frame < 50):
                continue
            for k in range(4):
                n += 1
                x, y = 60 * k + frame + rng.randrange(-4, 5), 40 + rng.randrange(-4, 5)
                rows.append((vid, frame, n, rng.choice(["face", "plate"]), x, y, x + 50, y + 50, 0.9, rng.random() < .05))
                if rng.random() < .3:
                    n += 1
                    rows.append((vid, frame, n, "face", x, y, x + 50, y + 50, 0.9, False))
    return rows


FRAMES = "video_id bigint, frame_no int, det_id bigint, type string, x1 int, y1 int, x2 int, y2 int, score double, is_auth boolean"


def loop_tracks(rows):
    """Frame after frame over one video, without any split."""
    out, live, nxt = [], [], 1
    frames = {}
    for r in rows:
        frames.setdefault(r[1], []).append(r)
    for frame in range(max(frames) + 1):
        for t in live:
            t["box"] = [b + v for b, v in zip(t["box"], t["v"])]
            t["missed"] += 1
        if frame % 5 == 0:
            taken = set()
            for r in sorted(frames.get(frame, []), key=lambda r: r[2]):
                best, share = None, 0.3
                for t in live:
                    if t["id"] not in taken and t["old"] and iou(r[4:8], t["box"]) > share:
                        best, share = t, iou(r[4:8], t["box"])
                if best:
                    best["v"] = [.5 * v + .5 * (n - b) for v, n, b in zip(best["v"], r[4:8], best["box"])]
                    best.update(box=[float(v) for v in r[4:8]], missed=0, type=r[3], auth=best["auth"] or r[9])
                    taken.add(best["id"])
                else:
                    live.append({"id": nxt, "box": [float(v) for v in r[4:8]], "v": [0.0] * 4, "missed": 0, "type": r[3], "auth": r[9], "old": False})
                    nxt += 1
            live = [dict(t, old=True) for t in live if t["missed"] <= 2]
        out += [(rows[0][0], frame, t["id"], *[int(v) for v in t["box"]], t["type"], t["auth"]) for t in live]
    return out


def test_tracks(spark, frame_dets):
    got = video.track(spark.createDataFrame(frame_dets, FRAMES)).collect()
    want = [row for vid in (1, 2) for row in loop_tracks([r for r in frame_dets if r[0] == vid])]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("moving", [False, True])
def test_stitched_segments(spark, frame_dets, monkeypatch, moving):
    """Small segments with short warm-ups equal one walk: resting boxes, where guesses hold, and moving ones, where seams are redone."""
    monkeypatch.setattr(video, "TRACK_SEGMENT", 4)
    monkeypatch.setattr(video, "TRACK_WARM_UP", 3)
    monkeypatch.setattr(video, "TRACK_ROUNDS", 2)
    rng = random.Random(3)
    rows = []
    for vid in (1, 2, 3):
        things = [[rng.randrange(900), rng.randrange(900), rng.randrange(-4, 5) if moving else 0] for _ in range(5)]
        for frame in range(0, 400, 5):
            if frame == 200 and vid == 2:
                continue  # a gap ends all tracks
            for i, (x, y, v) in enumerate(things):
                if rng.random() < 0.9:
                    shift = v * frame // 5
                    rows.append((vid, frame, i, "face", x + shift, y + shift // 2, x + shift + 90, y + shift // 2 + 80, 1.0, rng.random() < 0.01))
            if rng.random() < 0.2:
                things[rng.randrange(5)][:2] = rng.randrange(900), rng.randrange(900)
    got = video.track(spark.createDataFrame(rows, FRAMES)).collect()
    want = [row for vid in (1, 2, 3) for row in loop_tracks([r for r in rows if r[0] == vid])]
    assert sorted(map(tuple, got)) == sorted(want) and any(r[-1] for r in want)


def test_votes(spark, frame_dets):
    want = []
    keys = sorted({r[:2] for r in frame_dets})
    for key in keys:
        rows, used = sorted([r for r in frame_dets if r[:2] == key], key=lambda r: r[2]), set()
        for i, r in enumerate(rows):
            if i in used:
                continue
            group = [j for j in range(i, len(rows)) if j not in used and (j == i or iou(r[4:8], rows[j][4:8]) > .5)]
            used.update(group)
            want.append((*key, r[2], len(group), *[int(sum(rows[j][c] for j in group) / len(group)) for c in range(4, 8)]))
    got = video.vote(spark.createDataFrame(frame_dets, FRAMES), ["video_id", "frame_no"]).select(
        "video_id", "frame_no", "det_id", "votes", "x1", "y1", "x2", "y2").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    two = video.vote(spark.createDataFrame(frame_dets, FRAMES), ["video_id", "frame_no"], least=2).count()
    assert two == sum(w[3] >= 2 for w in want)


def test_scan_over_segments(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = exclusive_scan(df, ["k"], F.floor(F.col("o") / 50), ["o"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}).collect()
    sums, tops, want = {}, {}, {}
    for k, o, v in rows:
        want[o] = (sums.get(k, 0), tops.get(k))
        sums[k], tops[k] = sums.get(k, 0) + v, max(v, tops.get(k, -1))
    assert {r.o: (r.s, r.m) for r in got} == want


def test_islands(spark):
    rng = random.Random(9)
    rows = [(1 if i % 3 else 2, float(s := rng.randrange(5000)), float(s + rng.choice([0, 1, 3, 400 if i % 50 == 0 else 2]))) for i in range(800)]
    rows += [(3, 0.0, 1.0), (3, 1.0, 2.0), (3, 2.5, 2.5), (3, 2.5, 9.0), (3, 3.0, 4.0)]
    want = []
    for key in (1, 2, 3):
        merged = []
        for _, s, e in sorted(r for r in rows if r[0] == key):
            if merged and s <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], e)
            else:
                merged.append([key, s, e])
        want += map(tuple, merged)
    df = spark.createDataFrame(rows, "audio_id bigint, start_time double, end_time double")
    got = islands(df, ["audio_id"], "start_time", "end_time", F.floor(F.col("start_time") / 100)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_short_hits_are_stretched_and_modes_checked(spark):
    words = spark.createDataFrame([(1, 0, "a", 0.0, 0.4), (1, 1, "b", 1.0, 1.1), (1, 2, "c", 2.0, 3.0), (2, 0, "z", 0.0, 1.0)],
                                  "audio_id bigint, pos bigint, word string, start_time double, end_time double")
    merged = spark.createDataFrame([(1, 0.0, 0.4), (1, 1.0, 1.1)], "audio_id bigint, start_time double, end_time double")
    got = sorted((r.audio_id, r.seg_no, r.start_ms, r.end_ms, r.action, r.length_ms) for r in audio.edit_list(words, merged, "silence").collect())
    assert got == [(1, 1, 0, 400, "silence", 400), (1, 2, 400, 1000, "keep", 600), (1, 3, 1000, 1100, "silence", 300),
                   (1, 4, 1100, 3000, "keep", 1900), (2, 0, 0, 1000, "keep", 1000)]
    with pytest.raises(ValueError):
        audio.edit_list(words, merged, "mute")


def test_spoken_phone_numbers(spark):
    said = ["call", "987", "654", "3210", "now", "987-654-3210", "5551234567", "x", "12"]
    words = spark.createDataFrame([(1, i, w, i * 1.0, i + .5) for i, w in enumerate(said)],
                                  "audio_id bigint, pos bigint, word string, start_time double, end_time double")
    numbered = audio.number_words(words)
    hits = audio.hit_words(numbered, audio.phone_spans(numbered))
    assert sorted(r.pos for r in hits.collect()) == [1, 2, 3, 5, 6]


def test_whole_video_run_like_a_loop(spark, folder):
    """The registered run over whole tables: vote, track, authorise, decide and report, video by video."""
    from veilframe.fixtures import view
    from veilframe.plans import media_queries as Q
    from veilframe.plans.registry import QUERIES

    frames = {r.video_id: r.frames for r in view(spark, folder, "v_videos").collect()}
    seen = {}
    for r in view(spark, folder, "v_frame_dets").collect():
        seen.setdefault(r.video_id, []).append(r)
    want, known = {}, 0
    for vid, length in frames.items():
        faces, plates, pii, keep = C.POLICIES[Q._MODES[vid % 7]]
        shown, live, nxt = {}, [], 1
        dets_ = [r for r in seen.get(vid, []) if r.frame_no % 5 == 0]
        for r in dets_:
            if r.type not in ("face", "plate") and pii:
                shown[r.type] = shown.get(r.type, 0) + min(5, max(0, length - r.frame_no))
        for frame in range(length):
            for t in live:
                t["box"] = [b + v for b, v in zip(t["box"], t["v"])]
                t["missed"] += 1
            if frame % 5 == 0:
                found, used = sorted([r for r in dets_ if r.frame_no == frame and r.type in ("face", "plate")], key=lambda r: r.det_id), set()
                box_of, old = (lambda r: (r.x1, r.y1, r.x2, r.y2)), list(live)
                for i, r in enumerate(found):
                    if i in used:
                        continue
                    group = [j for j in range(i, len(found)) if j not in used and (j == i or iou(box_of(r), box_of(found[j])) > .5)]
                    used.update(group)
                    box = [int(sum(box_of(found[j])[k] for j in group) / len(group)) for k in range(4)]
                    best, share = None, 0.3
                    for t in old:
                        if iou(box, t["box"]) > share:
                            best, share = t, iou(box, t["box"])
                    if best:
                        old = [t for t in old if t is not best]
                        best["v"] = [.5 * v + .5 * (n - b) for v, n, b in zip(best["v"], box, best["box"])]
                        best.update(box=[float(v) for v in box], missed=0, type=r.type, auth=best["auth"] or r.det_id % 50 == 0)
                    else:
                        live.append({"box": [float(v) for v in box], "v": [0.0] * 4, "missed": 0, "type": r.type, "auth": r.det_id % 50 == 0})
                        nxt += 1
                live = [t for t in live if t["missed"] <= 2]
            for t in live:
                known += t["auth"]
                if plates if t["type"] == "plate" else faces and not (keep and t["auth"]):
                    shown[t["type"]] = shown.get(t["type"], 0) + 1
        points = {k: C.REPORT_FACE_POINTS if k == "face" else C.REPORT_PLATE_POINTS if k == "plate" else
                  next((v for part, v in C.REPORT_TEXT_POINTS if part in k), C.REPORT_TEXT_DEFAULT) for k in shown}
        want[vid] = (length / 24, shown.get("face", 0), shown.get("plate", 0), {k: n for k, n in shown.items() if k not in ("face", "plate")},
                     min(50, sum(n * points[k] for k, n in shown.items())))
    got = {}
    for r in QUERIES["redact_video"](spark, folder).collect():
        x = json.loads(r.report)
        got[r.video_id] = (x["video_duration_sec"], x["faces_redacted"], x["plates_redacted"], json.loads(x["pii_detected"]), x["privacy_risk_score"])
    assert got == want and known and any(w[1] for w in want.values())
