"""Sinks: redacted texts, draw and edit lists, reports, examples, feedback."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.functions.scan import SEGMENT


def write_table(df: DataFrame, path: str, mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Parquet, optionally split into folders."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_texts(df: DataFrame, path: str, column: str = "redacted") -> None:
    """One line of text per row; line breaks inside a text are escaped."""
    df.select(F.regexp_replace(column, r"\R", r"\\n").alias("value")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_feedback(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append feedback rows, one folder per day, so old days can be dropped whole."""
    df.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def examples(labelled: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Labelled pages without any original text: stand-in words, boxes, labels.

    One example holds a page, or a stretch of 65536 token places of a longer one.
    """
    word = T.surrogate(F.col("text"))
    box = F.array(F.col("left_x"), F.col("top"), F.col("left_x") + F.col("width"), F.col("top") + F.col("height"))
    rows = labelled.select("doc_id", "page_no", F.floor(F.col("pos") / segment).alias("part"),
                           F.struct("pos", word.alias("w"), box.alias("b"), F.col("label").alias("l")).alias("t"))
    pages = rows.groupBy("doc_id", "page_no", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return pages.select("doc_id", "page_no", "part", F.transform("ts", lambda t: t["w"]).alias("words"),
                        F.transform("ts", lambda t: t["b"]).alias("boxes"), F.transform("ts", lambda t: t["l"]).alias("labels"))
