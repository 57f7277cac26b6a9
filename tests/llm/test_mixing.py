"""Mixing against DuckDB and plain water filling."""
import re
from collections import Counter, defaultdict

from compare import compare

from veilframe.llm import mixing
from veilframe.llm.registry import CHECKS, QUERIES

SCHEMA = "doc_id bigint, source string, text string, size string, target string, kind string"


def fill(sizes):
    """Targets by literal resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 2 * sizes[s] for s in over})


def test_same_as_sql(spark, folder, duck):
    assert compare(spark, duck, folder, QUERIES["op8_mixing"], CHECKS["op8_mixing"]) is None


def make(spark):
    rows = [(i, f"src{i % 5}" if i % 11 else None, "word " * (1 + i % 50), "x", "y", "z") for i in range(600)]
    rows += [(i, "hot", "many words here " * 3, "x", "y", "z") for i in range(1000, 1400)]
    rows += [(1000, "hot", "many words here " * 3, "x", "y", "z")] * 3
    rows += [(2000, "one", "long " * 20_000, "x", "y", "z"), (2001, "void", None, "x", "y", "z"), (2002, "void", " \n", "x", "y", "z"),
             (None, "src1", "no id here", "x", "y", "z")]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_words(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SEGMENT", 40)
    docs = make(spark)
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = fill(sizes)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r.size and len(r.positions) == -(-r.taken // max(r.size, 1))
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_schedule_shapes_positions(spark):
    """A rising source has fewer of its words early than a falling one."""
    docs = spark.createDataFrame([(i, "abc"[i % 3], "four words in all", "", "", "") for i in range(3000)], SCHEMA)
    early = Counter(r.source for r in mixing.mix(docs).collect() for p in r.positions if p < 0.5)
    whole = Counter(r.source for r in mixing.mix(docs).collect() for p in r.positions)
    share = {s: early[s] / whole[s] for s in "abc"}
    # Integrals up to one half: 7/12 falling, 1/2 even, 1/3 rising.
    assert abs(share["a"] - 7 / 12) < 0.02 and abs(share["b"] - 0.5) < 0.02 and abs(share["c"] - 1 / 3) < 0.02


def test_take_rows(spark):
    docs = make(spark)
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    for r in docs.select("source").distinct().collect():
        target = next((x.target for x in mixing.mix(docs).filter(docs.source.eqNullSafe(r.source)).limit(1).collect()), 0)
        assert abs(words[r.source] - target) <= (20_000 if r.source == "one" else 51)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0
