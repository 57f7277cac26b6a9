"""Near copies by Jaccard similarity of word shingles.

Two texts are near copies if the sets of their runs of ``WORDS`` lower-cased words
have a Jaccard similarity of at least ``LEAST``; a shorter text is one run.
Candidates share one of ``BANDS`` bands of ``ROWS`` minimum hashes, which a pair at
0.8 misses once in 20 000 times; each candidate is confirmed by its exact similarity.

All members of a band's bucket are paired up to ``LONG`` of them. In a larger one
each is paired with the ``PIVOTS`` least members, so that the pairs stay linear; two
members that are near copies of each other but of no common pivot are then linked only
by their other bands.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import checkpoint

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
LONG, PIVOTS = 32, 4


def shingles_of(text: bytes):
    """Distinct hashes of a text's shingles, sorted; a blank text has none."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = [b" ".join(words[i:i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs)))


def bands_of(shingles) -> list[int]:
    """One signed 64-bit key for each band; none without shingles."""
    import numpy as np
    import xxhash

    if not len(shingles):
        return []
    rng = np.random.default_rng(11)
    flip, factor = (rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        mixed = (shingles[at:at + 2048, None] ^ flip) * factor
        np.minimum(least, mixed.min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64)
    return keys.view(np.int64).tolist()


def similar(a: bytes, b: bytes) -> bool:
    """Whether two texts' exact similarity is at least ``LEAST``."""
    import numpy as np

    x, y = _shingles_kept(a), _shingles_kept(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and both >= LEAST * (len(x) + len(y) - both)


@lru_cache(256)
def _shingles_kept(text: bytes):
    return shingles_of(text)


def links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (a, b) between the fingerprints of near copies.

    ``prints`` has the fp and body of every row of ``docs``; body is ``xxhash64`` of the text.
    """
    import pyarrow as pa

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [bands_of(shingles_of(t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["body", "keys"])

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [similar(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes()) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    texts = docs.select(F.xxhash64("text").alias("body"), "text")
    banded = checkpoint(texts.mapInArrow(keyed, "body bigint, keys array<bigint>").dropDuplicates(["body"]))
    posted = banded.select("body", F.explode("keys").alias("key"))
    sizes = checkpoint(posted.groupBy("key").agg(F.count("*").alias("n"), F.min("body").alias("least")).filter("n > 1"))
    short = posted.join(sizes.filter(F.col("n") <= LONG).select("key"), "key")
    pairs = short.join(short.select("key", F.col("body").alias("other")), "key").filter(F.col("body") < F.col("other"))
    # Large buckets: the least members by as many hashes, each an aggregate without a sort.
    some = [F.min_by("body", F.xxhash64("body", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    many = posted.join(F.broadcast(sizes.filter(F.col("n") > LONG).select("key")), "key")
    pivots = many.groupBy("key").agg(*some).select("key", F.array_distinct(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("others"))
    starred = many.join(F.broadcast(pivots), "key").select("body", F.explode("others").alias("other")).filter(F.col("body") != F.col("other"))
    found = checkpoint(pairs.select("body", "other").union(
        starred.select(F.least("body", "other").alias("body"), F.greatest("body", "other").alias("other"))).distinct())
    # Bodies of one fingerprint are linked as it is.
    own = prints.groupBy("body").agg(F.min("fp").alias("fp"))
    met = found.select(F.explode(F.array("body", "other")).alias("body")).distinct()
    known = checkpoint(texts.join(met, "body").dropDuplicates(["body"]).join(own, "body").select("body", "fp", F.col("text").cast("binary").alias("bytes")))
    left = known.select("body", F.col("fp").alias("a"), F.col("bytes").alias("x"))
    right = known.select(F.col("body").alias("other"), F.col("fp").alias("b"), F.col("bytes").alias("y"))
    both = found.join(left, "body").join(right, "other").filter("a != b").select("a", "b", "x", "y")
    return both.mapInArrow(confirmed, "a bigint, b bigint").distinct()
