"""Scans: texts, media listings, tokens, predictions, feedback, calibration.

Every reader uses a declared schema, so no pass over the data is spent on
inferring one and column pruning reaches the files.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import schemas
from veilframe.functions import text as T

MEDIA_SUFFIXES = {"pdf": ["pdf"], "audio": ["wav", "mp3", "m4a", "ogg", "flac"]}


def content_hash(column: str | Column) -> Column:
    """Sixteen hex digits that name a piece of content."""
    return F.substring(F.md5(column), 1, 16)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def media(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A listing of media files by suffix (any case); contents are not read."""
    glob = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in MEDIA_SUFFIXES[kind])
    listing = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{glob}}}").option("recursiveFileLookup", "true")
    return listing.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def tokens(df: DataFrame) -> DataFrame:
    """OCR tokens without blanks."""
    return df.where(F.length(T.strip(F.col("text"))) > 0)


def predictions(df: DataFrame) -> DataFrame:
    """Model predictions that name a word and an entity."""
    return df.where((F.length("word") > 0) & (F.length("entity_group") > 0))


def timed_words(df: DataFrame) -> DataFrame:
    """Transcript words that carry both times."""
    return df.where(F.col("start_time").isNotNull() & F.col("end_time").isNotNull())


def labelled_examples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples, one JSON object a line; empty and broken lines fall out."""
    rows = spark.read.schema(schemas.LABELLED_EXAMPLE).json(path, mode="PERMISSIVE")
    return rows.where((F.size("words") > 0) & (F.size("labels") > 0))


def feedback(spark: SparkSession, path: str) -> DataFrame:
    """Feedback files, each one JSON array; files that do not parse are skipped."""
    schema = f"{schemas.FEEDBACK}, _corrupt_record string"
    rows = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def calibration(spark: SparkSession, path: str) -> DataFrame:
    """Calibration history: a map of lists to one row per entry."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.CALIBRATION).alias("m"))
    lists = raw.select(F.explode("m").alias("key", "entries"))
    entries = lists.select("key", F.posexplode("entries").alias("pos", "e"))
    return entries.select(
        "key", "pos", "e.score", "e.correct", "e.correction",
        F.timestamp_micros((F.col("e.timestamp") * 1000000).cast("bigint")).alias("ts"))
