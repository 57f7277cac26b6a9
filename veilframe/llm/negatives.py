"""Hard-negative mining by Kronecker-packed products.

Rows of one label are packed in tiles. For each component, a tile biases its
rows' values to be non-negative and puts them side by side into the fields of
one wide integer. A query vector (anchor) is multiplied with a tile once per
component: the sum of value times wide integer holds, after one constant is
added to every field, each row's inner product in its field, without carry
between fields, whatever the magnitudes. Fields are as wide as the largest sum
needs, so scores are exact.

Anchors are grouped in rounds of bounded bytes, which are broadcast; tiles stay
where they are and are never copied. A task keeps the best rows of each anchor
over all its tiles, and those of all tasks are merged by a limit per key that is
applied before the shuffle, so a label with any share of the rows is spread
over tasks. Positives are looked for in tiles of the anchor's label only,
negatives in those of other labels only: every pair of anchor and row is
multiplied once.

Defined results: rows with a null vec_id, label or vector or a null or
non-finite component take no part, nor do vectors so long that a product could
pass 64 bits (a norm of 2**30 after scaling); of vectors of different lengths the
components that both have count; equal rows are one anchor, but each is a
candidate; rows that share an anchor's vec_id are no candidates for it; an
anchor without positives gives no rows; an empty table gives an empty result;
other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import mul

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.registry import query
from veilframe.session import checkpoint, scratch_path

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: Rows to a tile, anchors to a block, bytes of anchors to a round.
TILE, BLOCK, ROUND_BYTES = 1024, 256, 16 << 20
_TILE_ROW = "label bigint, size int, bias bigint, width int, lift binary, ids binary, parts array<binary>, turn int"
_BEST = "key bigint, anchor_id bigint, positive_id bigint, positive_score bigint, positive_no int, id bigint, score bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part."""
    x = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x)
    square = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") * SCALE, F.lit(2.0)))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)) & (square < float(1 << 60))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(sound)


def _scaled(x: Column) -> Column:
    return F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))


def pack(values, reach: int) -> tuple[int, int, bytes, list[bytes]]:
    """Bias, field width in bytes, lift and one wide integer per component of a tile.

    ``values`` has one row per vector. ``reach`` bounds an anchor's sum of
    magnitudes; ``lift`` is what makes every field of a sum non-negative.
    """
    import numpy as np

    bias = int(max(0, -values.min(initial=0)))
    high = int(values.max(initial=0)) + bias
    most = max(1, reach * high)  # of any field, up or down
    width = (2 * most).bit_length() // 8 + 1
    n = len(values)
    raw = np.ascontiguousarray(values.T + bias).astype("<i8").view(np.uint8).reshape(values.shape[1], n, 8)
    field = np.zeros((values.shape[1], n, width), np.uint8)
    field[:, :, :min(8, width)] = raw[:, :, :min(8, width)]
    return bias, width, most.to_bytes(width, "little"), [f.tobytes() for f in field]


def scores(anchor: list[int], parts: list[int], n: int, bias: int, width: int, lift: int, lifted: int):
    """Inner products of an anchor with the n rows of a tile; ``lifted`` has ``lift`` in every field."""
    import numpy as np

    packed = (sum(map(mul, anchor, parts)) + lifted).to_bytes(n * width + 1, "little")
    fixed = lift + bias * sum(anchor[:len(parts)])
    if width < 8:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(packed, np.uint8, n * width).reshape(n, width)
        return wide.view("<i8")[:, 0] - fixed
    return np.array([int.from_bytes(packed[i:i + width], "little") - fixed for i in range(0, n * width, width)], np.int64)


def _tiles(rows: DataFrame, reach: int) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        waiting: dict = {}

        def tile(key, ids, values):
            order = np.argsort(ids, kind="stable")
            bias, width, lift, parts = pack(values[order], reach)
            return {"label": key[0], "size": len(ids), "bias": bias, "width": width, "lift": lift, "ids": ids[order].tobytes(), "parts": parts, "turn": 0}

        def out(rows):
            return pa.RecordBatch.from_pylist(rows, pa.schema([
                ("label", pa.int64()), ("size", pa.int32()), ("bias", pa.int64()), ("width", pa.int32()), ("lift", pa.binary()),
                ("ids", pa.binary()), ("parts", pa.list_(pa.binary())), ("turn", pa.int32())]))

        def settle(least):
            """Tiles of the labels with at least so many rows waiting."""
            for key in [k for k, v in waiting.items() if sum(len(i) for i, _ in v) >= least]:
                ids, values = map(np.concatenate, zip(*waiting.pop(key)))
                for at in range(0, len(ids), TILE):
                    yield out([tile(key, ids[at:at + TILE], values[at:at + TILE])])

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes)])
            for label, size in set(zip(labels.tolist(), sizes.tolist())):
                at = np.flatnonzero((labels == label) & (sizes == size))
                waiting.setdefault((label, size), []).append((ids[at], flat[begins[at][:, None] + np.arange(size)]))
            yield from settle(4 * TILE)
            if sum(len(i) for v in waiting.values() for i, _ in v) > 64 * TILE:  # many small labels
                yield from settle(1)
        yield from settle(1)

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, _TILE_ROW)


def _multiplied(met: DataFrame, begin: Callable, same: bool) -> DataFrame:
    """Run tiles against the blocks beside them; ``begin()`` gives what keeps the best of a task."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        keep, last = begin(), None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                raw = row["ids"].as_buffer()
                if last is None or not raw.equals(last):
                    last, ids, label = raw, np.frombuffer(raw, np.int64), row["label"].as_py()
                    n, bias, width = (row[k].as_py() for k in ("size", "bias", "width"))
                    lift = row["lift"].as_py()
                    lifted, lift = int.from_bytes(lift * n, "little"), int.from_bytes(lift, "little")
                    parts = [int.from_bytes(p.as_buffer(), "little") for p in row["parts"]]
                for a in row["anchors"].as_py():
                    if (a["label"] == label) == same:
                        keep.add(a, ids, scores(a["q"], parts, n, bias, width, lift, lifted))
        rows = keep.rows()
        names = [c.split()[0] for c in _BEST.split(", ")]
        for at in range(0, len(rows), 1 << 16):
            columns = list(zip(*rows[at:at + (1 << 16)]))
            yield pa.record_batch([pa.array(c, pa.int32() if k == "positive_no" else pa.int64()) for k, c in zip(names, columns)], names=names)

    return met.select("label", "size", "bias", "width", "lift", "ids", "parts", "anchors").mapInArrow(run, _BEST)


class _Best:
    """The first few (score, id) of each slot: by score, then by smaller id."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def add(self, slot, ids, found) -> None:
        import numpy as np

        old = self.held.get(slot)
        if old is not None:
            found, ids = np.concatenate([old[0], found]), np.concatenate([old[1], ids])
        order = np.lexsort((ids, -found))[:self.most]
        self.held[slot] = found[order], ids[order]

    def floor(self, slot) -> int | None:
        """The least score that can still enter, if the slot is full."""
        old = self.held.get(slot)
        return int(old[0][-1]) if old is not None and len(old[0]) == self.most else None


class _Positives:
    def __init__(self):
        self.best = _Best(POSITIVES)

    def add(self, a: dict, ids, found) -> None:
        slot, floor = (a["key"], a["id"]), self.best.floor((a["key"], a["id"]))
        at = (ids != a["id"]) if floor is None else (ids != a["id"]) & (found >= floor)
        if at.any():
            self.best.add(slot, ids[at], found[at])

    def rows(self) -> list[tuple]:
        return [(key, anchor, None, None, None, i, s) for (key, anchor), (found, ids) in self.best.held.items() for s, i in zip(found.tolist(), ids.tolist())]


class _Negatives:
    """Per positive the first rows whose score lies between 80 % of the positive's and the positive's."""

    def __init__(self):
        self.best = _Best(NEGATIVES)

    def add(self, a: dict, ids, found) -> None:
        import numpy as np

        wanted = [(no, p["id"], p["score"], max(-(-4 * p["score"] // 5), self.best.floor((a["key"], a["id"], no, p["id"], p["score"])) or 0))
                  for no, p in enumerate(a["positives"]) if p["score"] >= 0]
        if not wanted:
            return
        at = np.flatnonzero((found >= min(w[3] for w in wanted)) & (ids != a["id"]))
        if not len(at):
            return
        found, ids = found[at], ids[at]
        for no, positive, top, low in wanted:
            inside = (found >= low) & (found <= top)
            if inside.any():
                self.best.add((a["key"], a["id"], no, positive, top), ids[inside], found[inside])

    def rows(self) -> list[tuple]:
        return [(key, anchor, positive, top, no, i, s) for (key, anchor, no, positive, top), (found, ids) in self.best.held.items()
                for s, i in zip(found.tolist(), ids.tolist())]


def _first(rows: DataFrame, slot: list[str], most: int, to: str) -> DataFrame:
    """The first few rows of each slot by score, then id, numbered from 1."""
    along = Window.partitionBy(*slot).orderBy(F.col("score").desc(), "id")
    return rows.withColumn(to, F.row_number().over(along)).filter(F.col(to) <= most)


def _pass(tiles: DataFrame, anchors: DataFrame, rounds: int, begin: Callable, same: bool) -> DataFrame:
    """What every task found best, over all rounds, written."""
    path = scratch_path(tiles.sparkSession, "negatives")
    item = F.struct("key", F.col("vec_id").alias("id"), "label", "q", *([] if same else ["positives"]))
    for turn in range(rounds):
        some = anchors.filter(F.pmod("key", F.lit(rounds)) == turn)
        split = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-some.count() // BLOCK))))
        if same:  # blocks of one label meet the tiles of that label
            met = tiles.join(F.broadcast(some.groupBy("label", split).agg(F.collect_list(item).alias("anchors")).select("label", "anchors")), "label")
        else:  # every tile meets every block of the round
            blocks = some.groupBy(split).agg(F.collect_list(item).alias("anchors")).select(F.lit(0).alias("turn"), "anchors")
            met = tiles.join(F.broadcast(checkpoint(blocks)), "turn")
        _multiplied(met, begin, same).write.mode("append").parquet(path)
    return tiles.sparkSession.read.schema(_BEST).parquet(path)


def mine(vectors: DataFrame, is_anchor: Column) -> DataFrame:
    """Hard negatives of each anchor and positive: rows of another label whose score
    is at most the positive's and at least 80 % of it.

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    picked = rows.filter(is_anchor).withColumn("q", _scaled(F.col("embedding")))
    anchors = checkpoint(picked.select(F.xxhash64("vec_id", "label", "q").alias("key"), "vec_id", "label", "q").distinct())
    reach = F.aggregate("q", F.lit(0).cast("bigint"), lambda s, v: s + F.abs(v))
    count, wide, reach = anchors.agg(F.count("*"), F.max(F.size("q")), F.max(reach)).first()
    rounds = max(1, math.ceil((count or 0) * ((wide or 0) * 8 + 200) / ROUND_BYTES))
    path = scratch_path(spark, "tiles")
    _tiles(rows, reach or 1).write.parquet(path)
    tiles = spark.read.schema(_TILE_ROW).parquet(path)
    positives = _first(_pass(tiles, anchors, rounds, _Positives, True), ["key", "anchor_id"], POSITIVES, "no")
    listed = positives.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "id", "score"))), lambda p: F.struct(p["id"], p["score"])).alias("positives"))
    found = _pass(tiles, checkpoint(anchors.join(listed, "key")), rounds, _Negatives, False)
    ranked = _first(found, ["key", "anchor_id", "positive_no", "positive_id", "positive_score"], NEGATIVES, "rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                         "positive_score", F.col("score").alias("negative_score"))


CHECK = """
WITH v AS (SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same,
  list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", CHECK)
def _negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)
