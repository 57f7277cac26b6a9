"""Helpers the training-data operators share."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.session import checkpoint

#: Words are runs of anything but these; the same set is Python's ``bytes.split()``.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often it is used.

    A lambda variable is not copied by the optimiser, unlike a projected column.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD + "+")).cast("bigint")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes empty.

    ``lower`` has a fast path for texts of single-byte letters, where it
    does just this; other texts take the letter table.
    """
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower()))


#: Tables of keys of at most 48 bytes a row are broadcast up to this many rows.
BROADCAST_ROWS = 500_000
#: A key with more than this share of all rows is hot; there are at most 1/share of them.
HOT_SHARE = 0.001


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to a table with unique keys of which some may hold most rows.

    ``weight`` is a column of the table with the number of rows of each key and
    ``total`` that of all. Hot keys, at most 1/HOT_SHARE, are joined by
    broadcast, all others by a shuffle in which no key is large. ``rows`` is read
    twice, so it should be written or cheap.
    """
    hot = F.col(weight) > HOT_SHARE * total
    hot_keys = F.broadcast(table.filter(hot).select(key))
    cold = rows.join(hot_keys, key, "left_anti").join(table.filter(~hot), key, how)
    return rows.join(F.broadcast(table.filter(hot)), key, "left_semi" if how == "left_semi" else "inner").unionByName(cold)


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those that ``verdicts`` drops, columns unchanged.

    Verdicts are narrow: doc_id, body (``xxhash64`` of the text) and kept, for
    the rows of groups that lose some. Where a kept row has dropped repeats of
    itself, equal in doc_id and text, all go and one comes back; which one is
    left open if other columns differ.
    """
    keys = checkpoint(verdicts.groupBy(F.col("doc_id").alias("_vf_id"), F.col("body").alias("_vf_body")).agg(
        F.max("kept").alias("_vf_stays"), F.min("kept").alias("_vf_alone")).filter("not _vf_alone"))
    goes, back = keys.drop("_vf_stays", "_vf_alone"), keys.filter("_vf_stays").drop("_vf_stays", "_vf_alone")
    if goes.count() <= BROADCAST_ROWS:
        goes, back = F.broadcast(goes), F.broadcast(back)
    names = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select("*", F.xxhash64("text").alias("_vf_own"))
    same = F.col("doc_id").eqNullSafe(F.col("_vf_id")) & (F.col("_vf_own") == F.col("_vf_body"))
    kept = own.join(goes, same, "left_anti").select(*names)
    if keys.filter("_vf_stays").isEmpty():
        return kept
    return kept.unionByName(own.join(back, same, "left_semi").dropDuplicates(["doc_id", "_vf_own"]).select(*names))


SPANS = "array<struct<kind:string,start:int,stop:int,base:boolean>>"


def scan_texts(docs: DataFrame, find: Callable[[], Callable[[str], list[tuple]]]) -> DataFrame:
    """doc_id and spans of every row; ``find()``, called once per task, gives the
    function from a text to its (kind, start, stop, base) spans."""
    import pyarrow as pa

    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])

    def run(batches):
        spans_of = find()
        for batch in batches:
            found = [[dict(zip(("kind", "start", "stop", "base"), s)) for s in spans_of(t.as_py() or "")] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(item))], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def span_digests(found: DataFrame, counted: list[str]) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and a list of all, in the order given."""
    found = found.select("doc_id", F.col("spans").alias("_s"))
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("_s", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("_s", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in counted],
        F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("_s", line), ",").alias("spans"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
