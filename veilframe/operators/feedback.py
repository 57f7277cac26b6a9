"""Feedback loop: quality counts, pattern switches, thresholds, calibration.

Keys here are few and busy (one label can hold most rows). Counts reduce on
the map side, and "last n per key" keeps only n rows per key and task before
anything is shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import text as T


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def quality(feedback: DataFrame) -> DataFrame:
    """Hits, false alarms and misses per label and per pattern, with rates."""
    named = feedback.select(
        F.coalesce("label", F.lit("UNKNOWN")).alias("label"), F.coalesce("pattern", F.lit("UNKNOWN")).alias("pattern"),
        "user_feedback", "missed_detection")
    named = named.select("user_feedback", "missed_detection", F.inline(F.array(
        F.struct(F.lit("label").alias("scope"), F.col("label").alias("name")),
        F.struct(F.lit("pattern").alias("scope"), F.col("pattern").alias("name")))))
    counts = named.groupBy("scope", "name").agg(
        F.count_if("user_feedback").alias("tp"), F.count_if(~F.col("user_feedback")).alias("fp"),
        F.count_if("missed_detection").alias("fn"), F.count("user_feedback").alias("rated"))
    counts = counts.where("tp + fp + fn > 0")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("scope", "name", "tp", "fp", "fn", _share(tp, tp + fp).alias("precision"),
                         _share(tp, tp + fn).alias("recall"), _share(tp, F.col("rated")).alias("accuracy"))


def disabled_patterns(feedback: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Patterns to switch off: imprecise ones with enough ratings, and stored ones."""
    bad = quality(feedback).where(
        (F.col("scope") == "pattern") & (F.col("precision") < C.DISABLE_PRECISION)
        & (F.col("tp") + F.col("fp") >= C.DISABLE_SAMPLES)).select(F.col("name").alias("pattern"))
    return bad if stored is None else bad.unionByName(stored.select("pattern")).distinct()


def drop_disabled(found: DataFrame, disabled: DataFrame) -> DataFrame:
    """Detections whose pattern is still on.

    The list has at most one row per catalogue pattern, so it is broadcast.
    """
    return found.join(F.broadcast(disabled), "pattern", "left_anti")


def threshold_shifts(feedback: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Raised acceptance thresholds for labels that proved noisy."""
    noisy = quality(feedback).where(
        (F.col("scope") == "label") & (F.col("name") == C.SHIFT_LABEL) & (F.col("precision") < C.SHIFT_PRECISION))
    fresh = noisy.select(F.col("name").alias("label"), F.lit(C.SHIFT_VALUE).alias("shift"))
    if stored is None:
        return fresh
    return stored.select("label", "shift").join(fresh, "label", "left_anti").unionByName(fresh)


def join_feedback(detections: DataFrame, wrong: DataFrame, missed: DataFrame, order: list[str]) -> DataFrame:
    """Mark detections the user called wrong, all others right, and add misses.

    ``detections`` and ``wrong`` share the column ``det_no``; ``missed`` has
    (doc_id, word).
    """
    marked = detections.join(wrong.select("det_no", F.lit(True).alias("_w")), "det_no", "left")
    marked = marked.select(*order, "label", "pattern", "score", "word", F.col("_w").isNull().alias("user_feedback"),
                           F.lit(False).alias("missed_detection"))
    extra = missed.select("doc_id", F.lit("B-SENSITIVE").alias("label"), F.lit("MISSED_ENTITY").alias("pattern"), "word",
                          F.lit(True).alias("missed_detection"))
    return marked.unionByName(extra, allowMissingColumns=True)


def calibration_key(label: Column, pattern: Column) -> Column:
    return F.when(pattern.isNotNull() & (pattern != ""), F.concat_ws("_", label, pattern)).otherwise(label)


def corrections(feedback: DataFrame) -> DataFrame:
    """Calibration history from rated detections that carry a score."""
    score = F.col("score")
    return feedback.where(score.isNotNull() & F.col("user_feedback").isNotNull()).select(
        calibration_key(F.col("label"), F.col("pattern")).alias("key"), "event_id", "ts", "score",
        F.col("user_feedback").alias("correct"), F.when(F.col("user_feedback"), 1 - score).otherwise(-score).alias("correction"))


def last_per_key(history: DataFrame, n: int, tie: str = "event_id") -> DataFrame:
    """The newest ``n`` rows of every key."""
    newest = Window.partitionBy("key").orderBy(F.desc("ts"), F.desc(tie))
    return history.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def calibrate(detections: DataFrame, history: DataFrame) -> DataFrame:
    """Shift scores by the mean of a key's latest corrections.

    Keys come from the closed label and pattern vocabularies, so the table of
    means is small by construction and left to the optimiser to broadcast.
    """
    enough = history.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > C.CALIBRATION_MIN)
    exact = F.sum(F.col("correction").cast("decimal(18,6)")).cast("double") / F.count("*")
    means = last_per_key(history, C.CALIBRATION_LAST).groupBy("key").agg(exact.alias("_shift"))
    means = means.join(enough.select("key"), "key", "left_semi")
    keyed = detections.withColumn("key", calibration_key(F.col("label"), F.col("pattern"))).join(means, "key", "left")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col("_shift") * C.CALIBRATION_WEIGHT))
    return keyed.withColumn("calibrated", F.when(F.col("_shift").isNull() | F.col("score").isNull(), F.col("score")).otherwise(moved)).drop("_shift")


def noisy_scores(df: DataFrame, seed: Column, epsilon: float = 1.0) -> DataFrame:
    """Laplace noise on scores, clamped to 0..1; the draw comes from a row hash."""
    u = (T.hash_number(seed) + 0.5) / 4294967296.0 - 0.5
    noise = -F.signum(u) * F.log(1 - 2 * F.abs(u)) / epsilon
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + noise))
    return df.withColumn("noisy", F.when(F.col("score").isNotNull(), moved))


def retain(df: DataFrame, now: Column, ts: str = "ts", days: int = C.RETENTION_DAYS, enabled: bool = True) -> DataFrame:
    """Drop rows older than the retention period."""
    return df.where(F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")) if enabled else df


def session_id(started: Column) -> Column:
    """Sixteen hex digits of the session start's hash."""
    return F.substring(F.sha2(started.cast("string").cast("binary"), 256), 1, 16)


def issues(df: DataFrame, frame: str, box: list[str], issue: Column, model: Column, at: Column) -> DataFrame:
    """Annotation rows for detections a user reports as missed or wrong."""
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    return df.select(
        F.concat(F.lit("issue_"), stamp, F.lit("_"), F.col(frame).cast("string")).alias("issue_id"),
        F.col(frame).alias("frame_number"), F.array(*box).alias("bounding_box"), issue.alias("issue_type"),
        model.alias("model_type"), stamp.alias("timestamp"))
