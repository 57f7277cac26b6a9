"""Exact dedup over a stream with disk-backed state that never expires.

Documents become narrow arrivals: digest of the normalised text, doc_id, row
number and the file that holds the content. A stream aggregates arrivals by
digest. Its state, kept by RocksDB on each executor's disk and in the shared
folder, holds for every digest how often it came and the identifier and
locator of the row that stays. Digests that came more than once are hits: their
texts are read again and compared in full. Should texts of one digest differ,
they are grouped by the texts themselves.

Equal means identical after lower-casing A-Z; null counts as empty. The row
with the largest doc_id stays, a null doc_id loses to any other, and of
repeated rows one stays. State, arrivals and updates of a single run lie in the
shared folder, as the result is read from them; ``deliver`` keeps them in a folder of
the caller's, so that later deliveries meet them. Empty tables give empty results, and other columns are
neither read nor changed, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import common
from veilframe.llm.common import ascii_lower, documents, keep_rows, look_up
from veilframe.llm.registry import query
from veilframe.session import checkpoint, exists, remove, scratch_path

ARRIVAL = "doc_id bigint, sha binary, file string, body bigint, delivery bigint, row bigint"
_KEEP = ("doc_id", "delivery", "row", "file")
_STATE = "digest binary, group_size bigint, keep struct<doc_id:bigint,delivery:bigint,row:bigint,file:string>, batch bigint"
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: their logs should not reserve disk ahead.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # All stores of an executor share one cache, which their write buffers count against.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "192",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
}


def _digest(bits: int) -> Column:
    return F.substring("sha", 1, bits // 8)


def _sha(text: str = "text") -> Column:
    return F.unhex(F.sha2(ascii_lower(F.col(text)).cast("binary"), 256))


def arrivals(docs: DataFrame, folder: str) -> int:
    """Write one narrow row per document below ``folder``; returns the delivery's number.

    Row numbers are only stable because they are written.
    """
    path, spark = f"{folder}/arrivals", docs.sparkSession
    number = (spark.read.schema(ARRIVAL).parquet(path).agg(F.max("delivery")).first()[0] or 0) + 1 if exists(spark, path) else 1
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _sha().alias("sha"), F.input_file_name().alias("file"), F.xxhash64("text").alias("body"),
                F.lit(number).cast("bigint").alias("delivery"), F.monotonically_increasing_id().alias("row")).write.mode("append").parquet(path)
    return number


def registry(spark: SparkSession, folder: str, bits: int = 256, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Let the stream take in what has arrived since it last ran; one row per digest of its state.

    State, progress and the digests that each batch touched stay below ``folder``.
    A batch that runs again after a failure writes the same rows to the same place.
    """
    updates = f"{folder}/updates"
    before = {k: spark.conf.get(k, None) for k in _ROCKS}

    def touched(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    try:
        for k, v in _ROCKS.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(ARRIVAL).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{folder}/arrivals")
        states = stream.withColumn("digest", _digest(bits)).groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct(*_KEEP)).alias("keep"))
        states.writeStream.outputMode("update").foreachBatch(touched).trigger(availableNow=True).option(
            "checkpointLocation", f"{folder}/state").start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not exists(spark, updates):
        return spark.createDataFrame([], _STATE).drop("batch")
    held = spark.read.schema(_STATE).parquet(updates)
    if held.agg(F.min("batch") == F.max("batch")).first()[0]:
        return held.drop("batch")
    # A digest's last update is its state.
    last = held.groupBy("digest").agg(F.max(F.struct("batch", "group_size", "keep")).alias("_last"))
    return last.select("digest", "_last.group_size", "_last.keep")


def collided(docs: DataFrame, held: DataFrame, total: int, bits: int = 256) -> DataFrame:
    """Digests under which the full bytes of some two texts differ.

    Least and greatest text of a digest are partial aggregates, so a
    group of any size is compared without being gathered.
    """
    hits = held.filter(F.col("group_size") > 1).select("digest", "group_size")
    texts = docs.select(_sha().alias("sha"), ascii_lower(F.col("text")).alias("norm")).select(_digest(bits).alias("digest"), "norm")
    if hits.count() <= common.BROADCAST_ROWS:
        texts = texts.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
    else:
        texts = look_up(texts, hits, "digest", "group_size", total, "left_semi")
    ends = texts.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    return checkpoint(ends.filter(F.col("least") != F.col("most")).select("digest"))


def _columns(key: Column) -> list[Column]:
    stays = (F.col("row") == F.col("keep.row")) & (F.col("delivery") == F.col("keep.delivery"))
    return ["doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), key.alias("text_sha256"), "body"]


def _decide(docs: DataFrame, bits: int, folder: str | None = None) -> DataFrame:
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    once = folder is None
    folder = folder or scratch_path(spark, "exact")
    number = arrivals(docs, folder)
    came = spark.read.schema(ARRIVAL).parquet(f"{folder}/arrivals").filter(F.col("delivery") == number)
    total = came.count()
    held = registry(spark, folder, bits)
    sha = F.lower(F.hex("sha"))
    rows = came.withColumn("digest", _digest(bits))
    if not once:  # digests that earlier deliveries alone brought are none of this one's concern
        held = checkpoint(held.join(rows.select("digest").distinct(), "digest", "left_semi"))
    else:
        remove(spark, f"{folder}/state")
    clash = collided(docs, held, total, bits)
    if clash.isEmpty():
        return look_up(rows, held, "digest", "group_size", total).select(*_columns(sha))
    # Group what shares a digest by its text instead.
    path = scratch_path(spark, "collided")
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _sha().alias("sha"), ascii_lower(F.col("text")).alias("norm"), F.xxhash64("text").alias("body"),
                F.lit(number).alias("delivery"), F.monotonically_increasing_id().alias("row")).withColumn("digest", _digest(bits)).join(
        clash, "digest", "left_semi").write.parquet(path)
    met = spark.read.parquet(path)
    groups = met.groupBy("norm").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "delivery", "row")).alias("keep"))
    fine = look_up(rows.join(clash, "digest", "left_anti"), held.join(clash, "digest", "left_anti"), "digest", "group_size", total)
    return fine.select(*_columns(sha)).unionByName(met.join(groups, "norm").select(*_columns(sha)))


def dedup(docs: DataFrame, bits: int = 256) -> DataFrame:
    """Every row with the doc_id that stays for its text, the group's size and whether it stays.

    ``bits`` is the length of the digest that keys the state; short ones make
    texts collide, which the full comparison then sorts out.
    """
    return _decide(docs, bits).drop("body")


def deliver(docs: DataFrame, folder: str) -> DataFrame:
    """Like ``dedup`` for one delivery of many: ``folder``, below the shared one, keeps the state.

    Texts that an earlier delivery brought are recognised: group_size counts all
    deliveries so far, keep_id is the largest doc_id among them, and a row is kept only
    if no earlier row has a larger one. Texts of earlier deliveries are not at hand to
    compare, so across deliveries equality rests on the full SHA-256.
    """
    return _decide(docs, 256, folder).drop("body")


def keep_one(docs: DataFrame, bits: int = 256) -> DataFrame:
    """The rows that stay, with their own columns."""
    return keep_rows(docs, _decide(docs, bits).filter("group_size > 1"))


CHECK = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""


@query("op7_exact_dedup", CHECK)
def _exact(spark: SparkSession, folder: str) -> DataFrame:
    return dedup(documents(spark, folder))
