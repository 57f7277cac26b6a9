"""Transcripts: word offsets, hits, merged intervals and edit lists."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import text as T
from veilframe.functions.scan import SEGMENT, bind, exclusive_scan, islands, unfold
from veilframe.session import checkpoint

KEY = ["audio_id"]
SPAN_CELL = 64
STRETCH_SECONDS = 600


def number_words(words: DataFrame) -> DataFrame:
    """Character offsets of words in their transcript (one blank after each word).

    ``run`` names stretches of words that start with a digit, each with the
    word before it: no phone number crosses from one stretch into the next.
    """
    first = F.when(F.col("word").rlike(r"(?U)\A[\d-]"), 0).otherwise(1)
    scanned = exclusive_scan(words, KEY, F.floor(F.col("pos") / SEGMENT), ["pos"], {
        "start_char": ("sum", (F.length("word") + 1).cast("bigint")), "_runs": ("sum", first.cast("bigint"))})
    return scanned.withColumn("end_char", F.col("start_char") + F.length("word") + 1).withColumn(
        "run", F.col("_runs") + first).drop("_runs")


def phone_spans(words: DataFrame) -> DataFrame:
    """Loose phone numbers in transcripts as character spans."""
    texts = words.groupBy(*KEY, "run").agg(
        F.min("start_char").alias("base"), F.max(F.col("word").rlike(r"(?U)\d")).alias("digits"),
        F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("ws"))
    body = bind(texts.where("digits"), body=F.array_join(F.transform("ws", lambda w: w["word"]), " "))
    spans = unfold(body, [*KEY, "base"], T.find_spans(F.col("body"), [C.TRANSCRIPT_PHONE]), "s")
    return spans.select(*KEY, (F.col("base") + F.col("s.start")).alias("s"), (F.col("base") + F.col("s.end")).alias("e"))


def hit_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """Words that touch any span, each once.

    Words and spans meet in 64-character cells of the transcript, so a long
    transcript spreads over many join keys.
    """
    def celled(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(
            F.floor(F.col(start) / SPAN_CELL), F.floor((F.col(end) - 1) / SPAN_CELL))))

    w = celled(words, "start_char", "end_char")
    s = celled(spans.where("e > s").select(*KEY, F.col("s").cast("bigint"), F.col("e").cast("bigint")), "s", "e")
    on = [w[k] == s[k] for k in KEY + ["cell"]] + [w.start_char < s.e, w.end_char > s.s]
    met = w.join(s, on, "left_semi")
    # A word that spans two cells can be met twice.
    return met.groupBy(*KEY, "pos").agg(*[F.first(c).alias(c) for c in words.columns if c not in (*KEY, "pos")])


def merge_intervals(hits: DataFrame) -> DataFrame:
    """Join the time intervals of hits that overlap or touch."""
    timed = hits.select(*KEY, "start_time", "end_time")
    return islands(timed, KEY, "start_time", "end_time", F.floor(F.col("start_time") / STRETCH_SECONDS))


def edit_list(words: DataFrame, merged: DataFrame, mode: str = "beep") -> DataFrame:
    """What an audio editor has to do, in milliseconds and in order.

    Sound between hits stays; every hit is replaced by at least 300 ms.
    """
    if mode not in ("beep", "silence"):
        raise ValueError(f"mode must be beep or silence, not {mode!r}")
    ms = checkpoint(merged.select(
        *KEY, (F.col("start_time") * 1000).cast("bigint").alias("a"), (F.col("end_time") * 1000).cast("bigint").alias("b")))
    scanned = exclusive_scan(ms, KEY, F.floor(F.col("a") / (STRETCH_SECONDS * 1000)), ["a"], {
        "done": ("max", F.col("b")), "nth": ("sum", F.lit(1).cast("bigint"))})
    before = F.coalesce("done", F.lit(0))

    def row(no, start, end, action, length):
        return F.struct(no.alias("seg_no"), start.alias("start_ms"), end.alias("end_ms"), F.lit(action).alias("action"), length.alias("length_ms"))

    a, b = F.col("a"), F.col("b")
    body = scanned.select(*KEY, F.inline(F.array(
        row(F.col("nth") * 2, before, a, "keep", a - before),
        row(F.col("nth") * 2 + 1, a, b, mode, F.greatest(F.lit(C.MIN_REPLACEMENT_MS).cast("bigint"), b - a)))))
    ends = words.groupBy(*KEY).agg((F.max("end_time") * 1000).cast("bigint").alias("total"))
    done = ms.groupBy(*KEY).agg(F.max("b").alias("last"), F.count("*").alias("n"))
    tail = ends.join(done, KEY, "left").select(*KEY, F.inline(F.array(row(
        F.coalesce("n", F.lit(0)) * 2, F.coalesce("last", F.lit(0)), F.col("total"), "keep", F.col("total") - F.coalesce("last", F.lit(0))))))
    return body.unionByName(tail).where("action <> 'keep' OR length_ms > 0")
