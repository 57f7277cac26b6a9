"""SimHash near-dedup over an inverted index of byte positions.

A fingerprint has eight positional bytes; two that differ in at most two bits
share at least six of them. Each fingerprint is posted under fourteen sets of
four positional bytes (single bytes would pair nearly everything). Number the
bytes 0 to 7: the sets are those whose numbers cancel under exclusive or. Any
six bytes hold three of the sets, which cover the six; five bytes hold one. So the
bytes that a pair's shared postings prove, joined over all of them, are all the
bytes it shares if these are six or more, and only four if they are fewer. Pairs
with at least six proven bytes are verified by their differing bits, the others
are dropped by their tally. Copies collapse before indexing.

A posting of more than ``LONG`` fingerprints is not paired. There two members
link if and only if they have a common neighbour among the fingerprints that
differ from each in at most one bit of the other four bytes, so every
member is listed under its 33 neighbours and tied to the least fingerprint of
each list. That loses no link between groups and stays linear. A pair with a
long posting is found there, any other has all its postings in the tally.

Groups are connected components, found by alternating star contraction. With
``copies`` the near copies of ``jaccard`` (five words, 0.8) are linked as well.

Defined results: a null or blank text has fingerprint zero, linked like any
other; a text of one or two words is one shingle; a null doc_id joins its group
but names it only if the group has no other; repeated rows come out repeated;
an empty table gives an empty result; other columns are neither read nor changed.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import jaccard
from veilframe.llm.common import documents, keep_rows, look_up
from veilframe.llm.registry import query
from veilframe.session import checkpoint

SHINGLE = 3
SEED = 42
BITS = 2
#: Fingerprints in a posting up to which its members are paired.
LONG = 32
_SLOTS = [s for s in combinations(range(8), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def fingerprint_of(text: bytes) -> int:
    """The fingerprint as a signed 64-bit number."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # both know ASCII only, as asked for
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < SHINGLE:
        starts, ends = [0], [len(joined)]
    else:
        starts, ends = starts[:len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1:].tolist()
    digest, ones, block = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(starts), block):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + block], ends[at:at + block])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp and body (a hash of the text) of every row, from whole texts."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "body"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("body"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, body bigint")


def _mask(slot: tuple) -> int:
    mask = sum(255 << (8 * at) for at in slot)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def postings(nodes: DataFrame) -> DataFrame:
    """Every fingerprint under the value of each slot's positional bytes."""
    masks = F.array(*[F.lit(_mask(s)) for s in _SLOTS])
    return nodes.select("fp", F.posexplode(masks).alias("slot", "mask")).select(
        "fp", "slot", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def tallied(short: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a posting, with the positional bytes their postings prove."""
    other = short.select("slot", "key", F.col("fp").alias("b"))
    pairs = short.join(other, ["slot", "key"]).filter(F.col("fp") < F.col("b"))
    proven = F.get(F.array(*[F.lit(sum(1 << at for at in s)) for s in _SLOTS]), F.col("slot"))
    return pairs.groupBy(F.col("fp").alias("a"), "b").agg(F.bit_count(F.bit_or(proven)).alias("shared"))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough of them to connect
    all that differ in at most two bits; none that differ in more."""
    posted = postings(nodes)
    lengths = checkpoint(posted.groupBy("slot", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    short = posted.join(lengths.filter(F.col("n") <= LONG).drop("n"), ["slot", "key"])
    candidates = tallied(short).filter(F.col("shared") >= 8 - BITS)
    paired = candidates.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    # Long postings: list members under their neighbours in the free bits.
    free = [[1 << (8 * at + k) for at in range(8) if at not in slot for k in range(8)] for slot in _SLOTS]
    flips = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(f - (1 << 64) if f >= 1 << 63 else f).cast("bigint") for f in row]) for row in free])
    many = posted.join(lengths.filter(F.col("n") > LONG).drop("n"), ["slot", "key"])
    near = many.select("fp", F.explode(F.get(flips, F.col("slot"))).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("via")).distinct()
    least = checkpoint(near.groupBy("via").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1"))
    met = look_up(near, least, "via", "n", max(1, nodes.count()))
    starred = met.filter((F.col("fp") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= BITS))
    return paired.union(starred.select(F.col("fp").alias("a"), "b")).distinct()


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """One contraction: tie each node's neighbours to the least of them."""
    if large:
        both = edges.union(edges.select("b", "a"))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("m", "a").alias("m"), "n")
    met = look_up(both, least, "a", "n", total)
    if large:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(met.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each linked node with the least node of its component.

    Alternates large and small stars until the edges stay the same; the rounds
    grow with the logarithm of the longest chain.
    """
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = checkpoint(edges)
    before = state(edges)
    while before[0]:
        edges = checkpoint(_star(checkpoint(_star(edges, 2 * before[0], True)), 2 * before[0], False))
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, copies: bool = False) -> DataFrame:
    rows = checkpoint(fingerprints(docs))
    total = rows.count()
    nodes = checkpoint(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")))
    edges = links(nodes.select("fp"))
    tied = components(edges.union(jaccard.links(docs, rows)).distinct() if copies else edges)
    rooted = checkpoint(nodes.join(tied, nodes["fp"] == tied["node"], "left").select(
        "fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"), F.sum("n").alias("group_size"))
    table = look_up(rooted, named, "root", "fps", total)
    return look_up(rows, table.select("fp", "n", "root", "component_id", "group_size"), "fp", "n", total)


def near_dups(docs: DataFrame) -> DataFrame:
    """Every row with its fingerprint and the smallest doc_id of its group."""
    return _grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_size")


def keep_one(docs: DataFrame, copies: bool = False) -> DataFrame:
    """The rows that stay, columns unchanged: of each group that with the smallest doc_id."""
    rows = checkpoint(_grouped(docs, copies).filter("group_size > 1").select("doc_id", "body", "root"))
    total = rows.count()
    choice = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    chosen = rows.groupBy("root").agg(F.min(choice).alias("keep"), F.count("*").alias("n"))
    met = look_up(rows, chosen, "root", "n", total)
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("body") == F.col("keep.body"))
    # Repeats of the kept row: the verdict keeps only one of them.
    keys = met.groupBy("root", "doc_id", "body").agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    verdicts = keys.select("doc_id", "body", F.col("stays").alias("kept"), "rows")
    again = verdicts.filter("kept and rows > 1").select("doc_id", "body", F.lit(False).alias("kept"))
    return keep_rows(docs, verdicts.drop("rows").union(again))


@query("op6_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups(documents(spark, folder))
