"""What a run learns from its ratings, and the next run under it.

Ratings are kept by detection number, over as many runs and sessions as there
were. Everything learned is small by construction (a row per label or pattern
of closed vocabularies, at most 200 corrections per key, one model), so the
next run joins nothing large.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.operators import align, boxes, feedback, gate


class Lessons(NamedTuple):
    """Patterns to leave out, raised thresholds, corrections of scores, and the gate."""

    disabled: DataFrame
    shifts: DataFrame
    history: DataFrame
    model: PipelineModel | None


def rate(dets: DataFrame, ratings: DataFrame) -> DataFrame:
    """Detections with the newest rating stored under their number.

    ``ratings`` has det_no, event_id, ts and user_feedback. A detection without a
    rating, or whose newest one was taken back (null), counts as not rated; ratings
    of unknown numbers are left out. One number may be rated often: its ratings
    reduce before the shuffle.
    """
    newest = ratings.where("det_no IS NOT NULL").groupBy("det_no").agg(
        F.max(F.struct("ts", "event_id", "user_feedback")).alias("_r"))
    return dets.join(newest, "det_no", "left").select(
        *dets.columns, "_r.ts", "_r.event_id", "_r.user_feedback", F.lit(False).alias("missed_detection"))


def learn(rated: DataFrame, disabled: DataFrame | None = None, shifts: DataFrame | None = None, gated: bool = True) -> Lessons:
    """Lessons of rated detections, on top of what earlier runs stored.

    Without ``gated`` no model is trained; nor is there one below twenty ratings.
    """
    history = feedback.last_per_key(feedback.corrections(rated), C.CALIBRATION_KEEP)
    return Lessons(feedback.disabled_patterns(rated, disabled), feedback.threshold_shifts(rated, shifts), history,
                   gate.train(boxes.features(rated)) if gated else None)


def next_run(dets: DataFrame, preds: DataFrame, lessons: Lessons) -> DataFrame:
    """Detections of patterns still on and predictions above their thresholds, with calibrated scores.

    Predictions are located on their page later on and come without a box here;
    ``through_gate`` follows once every row has one.
    """
    live = feedback.drop_disabled(dets, lessons.disabled).withColumn("origin", F.lit("pattern"))
    named = align.accept(preds, lessons.shifts).withColumn("origin", F.lit("model")).withColumn("pattern", F.lit(None).cast("string"))
    columns = ["origin", "doc_id", "page_no", "word", "label", "pattern", "score"]
    every = live.select(*columns, "det_no").unionByName(named.select(*columns), allowMissingColumns=True)
    return feedback.calibrate(every, lessons.history).drop("key")


def through_gate(dets: DataFrame, lessons: Lessons) -> DataFrame:
    """Boxes the learned gate believes in; all of them where none was learned."""
    return gate.apply(boxes.features(dets), lessons.model)
