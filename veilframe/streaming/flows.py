"""Streams over the batch operators: redaction, counts and reports, feedback."""
from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe import catalogue as C
from veilframe import schemas
from veilframe.operators import report, text, video
from veilframe.session import children, remove, rename
from veilframe.sources import sinks


def frame_detections(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A folder of arriving detection files as a stream."""
    schema = f"{schemas.FRAME_DETECTIONS}, ts timestamp, is_auth boolean"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def redacted(texts: DataFrame, level: int = 1) -> DataFrame:
    """Redacted texts; a projection, so no state is kept."""
    return text.redact(text.detect(texts), level).drop("spans")


def running_counts(dets: DataFrame) -> DataFrame:
    """Detections per video and type so far (update mode)."""
    return dets.groupBy("video_id", "type").agg(F.count("*").alias("n"))


def hourly_rate(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Counts per kind and hour of event time; late rows fall out after ``delay``."""
    return report.hourly_rate(events.withWatermark("ts", delay))


def store_feedback(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all feedback by day, in whatever batches it arrives."""
    def append(batch: DataFrame, number: int) -> None:
        # The batch number makes a repeated batch overwrite itself.
        sinks.write_table(batch.withColumn("dt", F.to_date("ts")), f"{path}/batch={number}", by=["dt"])

    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).start()


def _numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    """Numbers of the folders ``key=number`` inside a folder."""
    return sorted(int(n.removeprefix(f"{key}=")) for n in children(spark, path) if n.startswith(f"{key}="))


def _days(spark: SparkSession, path: str) -> list[str]:
    """Days of stored feedback, by the names of their folders; rows are not read."""
    names = {n for b in _numbers(spark, path, "batch") for n in children(spark, f"{path}/batch={b}")}
    return sorted(n.removeprefix("dt=") for n in names if re.fullmatch(r"dt=\d{4}-\d{2}-\d{2}", n))


def stored_feedback(spark: SparkSession, path: str, days: int | None = C.RETENTION_DAYS) -> DataFrame:
    """Stored feedback no older than the retention period before the newest row of
    all, so what is kept does not depend on the batches it came in.

    The newest day is known from the folders, so only its rows are read for the newest
    time and only the days of the period for the result; ``days`` None keeps all.
    """
    finish_compaction(spark, path)
    kept = spark.read.parquet(path)
    stored = _days(spark, path)
    if days is None or not stored:
        return kept.drop("batch", "dt")
    newest = kept.where(F.col("dt") == F.lit(stored[-1]).cast("date")).agg(F.max("ts")).first()[0]
    since = newest - timedelta(days=days)
    return kept.where((F.col("dt") >= F.lit(since.date())) & (F.col("ts") >= F.lit(since))).drop("batch", "dt")


def finish_compaction(spark: SparkSession, path: str) -> None:
    """Put a written compaction in place of the batches it holds; also ends one that was interrupted."""
    for name in children(spark, path):
        if name.startswith("_compacted-") and "_SUCCESS" in children(spark, f"{path}/{name}"):
            upto = int(name.removeprefix("_compacted-"))
            for number in _numbers(spark, path, "batch"):
                if number <= upto:
                    remove(spark, f"{path}/batch={number}")
            rename(spark, f"{path}/{name}", f"{path}/batch={upto}")


def compact_feedback(spark: SparkSession, path: str, days: int | None = None) -> None:
    """Rewrite the batches but the newest, which may be written again, as one, in few files a day.

    Until it is complete the copy is hidden from readers; ``stored_feedback`` and the next
    compaction end one that was interrupted. With ``days``, whole days older than that before
    the newest day are left out.
    """
    finish_compaction(spark, path)
    done = _numbers(spark, path, "batch")[:-1]
    if len(done) < 2:
        return
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/batch={n}" for n in done]).drop("batch")
    if days is not None:
        oldest = date.fromisoformat(_days(spark, path)[-1]) - timedelta(days=days)
        rows = rows.where(F.col("dt") >= F.lit(oldest))
    sinks.write_table(rows.hint("rebalance", "dt"), f"{path}/_compacted-{done[-1]}", by=["dt"])
    finish_compaction(spark, path)


def store_counts(dets: DataFrame, path: str, checkpoint: str, every: int = 20) -> StreamingQuery:
    """Keep detections per video and type as a table that reports read instead of all detections.

    Each batch leaves its own counts under its number, so one that runs again replaces
    them. From time to time the counts of finished batches are added up into a
    total, under the number of the last one in it.
    """
    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sinks.write_table(running_counts(batch), f"{path}/part/batch={number}")
        totals = _totals(spark, path)
        if number - 1 - (totals[-1] if totals else -1) >= every:
            # Batches before this one are committed and never come again.
            sinks.write_table(stored_counts(spark, path, number - 1), f"{path}/total/upto={number - 1}")

    return dets.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def _totals(spark: SparkSession, path: str) -> list[int]:
    return [n for n in _numbers(spark, f"{path}/total", "upto") if "_SUCCESS" in children(spark, f"{path}/total/upto={n}")]


def stored_counts(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """Detections per video and type so far: the newest total and the batches after it."""
    totals = [n for n in _totals(spark, path) if upto is None or n <= upto]
    start = totals[-1] if totals else -1
    later = [n for n in _numbers(spark, f"{path}/part", "batch") if start < n and (upto is None or n <= upto)]
    paths = [f"{path}/part/batch={n}" for n in later] + ([f"{path}/total/upto={start}"] if totals else [])
    return spark.read.parquet(*paths).groupBy("video_id", "type").agg(F.sum("n").alias("n"))


def report_from_counts(spark: SparkSession, path: str, videos: DataFrame, fps: float) -> DataFrame:
    """The privacy reports of all videos, from the stored counts alone."""
    return video.report_of_counts(stored_counts(spark, path), videos.select("video_id", "frames"), fps)
