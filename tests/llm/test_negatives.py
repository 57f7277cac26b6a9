"""Hard negatives against DuckDB and plain products."""
import math
import random

import numpy as np
import pytest
from compare import compare
from pyspark.sql import functions as F

from veilframe.llm import negatives
from veilframe.llm.registry import CHECKS, QUERIES

SCHEMA = "vec_id bigint, label int, embedding array<double>, key string, score string, turn string"


def plain(rows):
    """(anchor, positive, rank, negative, scores) by exact Python integers."""
    good = [(i, k, [math.floor(256 * x) for x in v]) for i, k, v in rows
            if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in {(i, k, tuple(v)) for i, k, v in good if i % 100 == 0}:
        i, k, v = anchor
        scored = sorted((-sum(map(int.__mul__, v, w)), j, m) for j, m, w in good if j != i)
        for s, p, _ in [x for x in scored if x[2] == k][:5]:
            near = [x for x in scored if x[2] != k and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, p, rank, j, -s, -t) for rank, (t, j, _) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.mine(frame, F.col("vec_id") % 100 == 0).collect()))


def test_same_as_sql(spark, folder, duck):
    assert compare(spark, duck, folder, QUERIES["op13_hard_negatives"], CHECKS["op13_hard_negatives"]) is None


@pytest.mark.parametrize("scale", [1, 1000, 90_000_000])
def test_packed_products_are_exact(scale):
    """Fields from two to more than eight bytes, negative anchors, shorter vectors."""
    rng = np.random.default_rng(scale)
    rows = rng.integers(-scale, scale + 1, (37, 9))
    anchors = rng.integers(-3 * scale, scale + 1, (20, 9)).tolist() + [[0] * 9, [3 * scale] * 9, [-3 * scale] * 9, [1, -1]]
    bias, width, lift, parts = negatives.pack(rows, 27 * scale)
    wide = [int.from_bytes(p, "little") for p in parts]
    lifted, lift = int.from_bytes(lift * 37, "little"), int.from_bytes(lift, "little")
    for a in anchors:
        got = negatives.scores(a, wide, 37, bias, width, lift, lifted)
        assert got.tolist() == [sum(x * int(y) for x, y in zip(a, r)) for r in rows]


def test_like_plain_products_with_ties(spark, monkeypatch):
    """Few distinct vectors, a hot label, small tiles, several rounds and blocks."""
    monkeypatch.setattr(negatives, "TILE", 16)
    monkeypatch.setattr(negatives, "BLOCK", 2)
    monkeypatch.setattr(negatives, "ROUND_BYTES", 1000)
    rng = random.Random(3)
    pool = [[rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(4)] for _ in range(25)]
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice(pool)) for i in range(0, 2500, 4)]
    got = mined(spark, rows)
    assert got == plain(rows) and len(got) > 100


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 2, [0.9, 5.0]), (3, 2, [0.9]), (4, 2, [nan, 1.0]), (5, 2, [0.9, inf]), (6, 2, [0.9, None]),
            (7, None, [0.9, 0.0]), (None, 2, [0.9, 0.0]), (8, 2, None), (9, 3, []), (100, 4, [1.0, 1.0]), (200, 3, [0.0, -1.0]), (10, 3, [0.0, 1.0]),
            (1, 1, [1.0, 0.1]), (0, 1, [1.0, 0.0]), (11, -5, [0.95, 0.0]), (12, 2, [-3.0, -3.0])]
    got = mined(spark, rows)
    assert got == plain(rows) and {r[0] for r in got} == {0, 200}
    assert not mined(spark, rows + [(300, 9, [1e300, 0.0]), (13, 9, [1e300, 0.0])])[len(got):]
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == []
