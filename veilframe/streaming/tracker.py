"""Box tracking on a stream of frame detections: one keyed state per video, cleared when the video ends."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilframe import catalogue as C
from veilframe.functions import tracking

OUTPUT = "video_id bigint, frame_no int, track_id bigint, x1 int, y1 int, x2 int, y2 int, type string, authorised boolean"
_STEP = C.DETECTION_INTERVAL
_WAITING = "ts bigint, frame_no int, det_id bigint, x1 int, y1 int, x2 int, y2 int, type string, is_auth boolean"
_TRACK = "x1 double, y1 double, x2 double, y2 double, vx1 double, vy1 double, vx2 double, vy2 double, missed int, type string, authorised boolean"
_PROGRESS = "next bigint, seen int, at int, newest bigint, frames int, timer bigint"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Live:
    """A video's live tracks and how far it has come."""

    def __init__(self, video: int, tracks: list, next_id: int, seen: int | None, at: int | None):
        self.video, self.tracks, self.next, self.seen, self.at = video, tracks, next_id, seen, at

    def advance(self, last: int) -> list[tuple]:
        """Predict the live tracks on frames up to ``last``, short of the next detection frame."""
        out = []
        for frame in range(self.at + 1, min(last, self.seen + _STEP - 1) + 1):
            tracking.predict(self.tracks)
            out += tracking.rows(self.tracks, self.video, frame)
            self.at = frame
        return out

    def settle(self, ready: list[tuple]) -> list[tuple]:
        """Work through complete frames in order."""
        out: list[tuple] = []
        frames: dict[int, list] = {}
        for row in ready:
            frames.setdefault(row[1], []).append(row)
        for frame in sorted(frames):
            if self.seen is not None:
                out += self.advance(frame - 1 if frame % _STEP == 0 else frame)
            if frame % _STEP:
                continue
            if self.seen is not None and frame > self.seen + _STEP:
                # A detection frame in between saw nothing, which ends every track.
                self.tracks = []
            found = [tuple(r[3:9]) for r in sorted(frames[frame], key=lambda r: r[2])]
            self.tracks, self.next = tracking.update(self.tracks, found, self.next)
            self.seen = self.at = frame
            out += tracking.rows(self.tracks, self.video, frame)
        return out


class BoxTracker(StatefulProcessor):
    """Rows wait in list state until the watermark passes them; live tracks are map state.

    A video has one timer: for its earliest waiting row or, if none waits, for the
    time ``idle`` milliseconds after its newest. When the latter fires the video has
    ended: its tail is predicted and all of its state goes.
    """

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.tracks = handle.getMapState("tracks", "track_id bigint", _TRACK)
        self.progress = handle.getValueState("progress", _PROGRESS)

    def _wake(self, old: int | None, at: int) -> int:
        """Move the video's timer."""
        if old is not None and old != at:
            self.handle.deleteTimer(old)
        if old != at:
            self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came, frames = [], None
        for batch in rows:
            columns = [batch[c].tolist() for c in ("ms", "frame_no", "det_id", "x1", "y1", "x2", "y2", "type", "is_auth")]
            came += zip(*columns)
            known = batch["frames"].max()
            frames = frames if pd.isna(known) else max(int(known), frames or 0)
        self.waiting.appendList(came)
        following, seen, at, newest, length, timer = self.progress.get() if self.progress.exists() else (1, None, None, None, None, None)
        first, last = min(r[0] for r in came), max(r[0] for r in came)
        idle = not came or timer is None or (newest is not None and timer == newest + self.idle)
        timer = self._wake(timer, first if idle else min(timer, first))
        self.progress.update((following, seen, at, max(last, newest or last), max(filter(None, (frames, length)), default=None), timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        following, seen, at, newest, length, _ = self.progress.get()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        live = _Live(int(key[0]), [[k[0], *v] for k, v in self.tracks.iterator()] if self.tracks.exists() else [], following, seen, at)
        live.tracks.sort(key=lambda t: t[0])
        ready, left = [r for r in waiting if r[0] <= mark], [r for r in waiting if r[0] > mark]
        out = live.settle(ready)
        ended = not left and newest + self.idle <= mark
        if ended:
            if live.seen is not None and length is not None:
                out += live.advance(length - 1)
            for state in (self.waiting, self.tracks, self.progress):
                state.clear()
        else:
            self.waiting.put(left) if left else self.waiting.clear()
            self.tracks.clear()
            for t in live.tracks:
                self.tracks.updateValue((t[0],), tuple(t[1:]))
            timer = self._wake(None, min(r[0] for r in left) if left else newest + self.idle)
            self.progress.update((live.next, live.seen, live.at, newest, length, timer))
        if out:
            yield pd.DataFrame(out, columns=[part.strip().split(" ")[0] for part in OUTPUT.split(",")])


def track_stream(dets: DataFrame, delay: str = "10 seconds", idle: int = 60) -> DataFrame:
    """Tracks of a detection stream with columns of ``FRAME_DETECTIONS`` plus ``ts`` (event
    time) and, optionally, ``is_auth`` and ``frames``, the video's length.

    Frames may arrive in any order within ``delay``. A video that brings nothing for
    ``idle`` seconds of event time has ended; what arrives for it later counts as a new
    video. Boxes are predicted up to its last frame if its length is given, else up to
    its last detection. The state lies in RocksDB, which this sets for the session.
    """
    dets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    known = F.col("is_auth") if "is_auth" in dets.columns else F.lit(False)
    length = F.col("frames").cast("int") if "frames" in dets.columns else F.lit(None).cast("int")
    rows = dets.withWatermark("ts", delay).select(
        "video_id", "ts", F.unix_millis("ts").alias("ms"), "frame_no", "det_id", "x1", "y1", "x2", "y2", "type",
        F.coalesce(known, F.lit(False)).alias("is_auth"), length.alias("frames"))
    return rows.groupBy("video_id").transformWithStateInPandas(
        BoxTracker(idle * 1000), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
