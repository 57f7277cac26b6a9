"""Exact dedup against DuckDB and plain grouping."""
import hashlib
from collections import defaultdict

import pytest
from compare import compare

from veilframe.llm import common, exact
from veilframe.llm.registry import CHECKS, QUERIES

SCHEMA = "doc_id bigint, text string, sha string, digest string, row string, kept string"
TEXTS = [(1, "Same"), (2, "sAME"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, " "), (8, "long " * 30_000), (9, "LONG " * 30_000),
         (9, "LONG " * 30_000), (None, "same"), (11, "alone"), (12, "straße"), (13, "STRAßE")]


def lower(text):
    return (text or "").encode().lower()


def test_same_as_sql(spark, folder, duck):
    assert compare(spark, duck, folder, QUERIES["op7_exact_dedup"], CHECKS["op7_exact_dedup"]) is None


@pytest.mark.parametrize("bits", [256, 8])
def test_defined_cases(spark, bits):
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in TEXTS], SCHEMA)
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[lower(t)].append(i)
    got = exact.dedup(docs, bits).collect()
    assert len(got) == len(TEXTS)
    want = sorted(((i, max(x for x in groups[lower(t)] if x is not None), len(groups[lower(t)]), hashlib.sha256(lower(t)).hexdigest())
                   for i, t in TEXTS), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sorted((r.text_sha256 for r in got if r.kept)) == sorted(hashlib.sha256(k).hexdigest() for k in groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact.keep_one(docs, bits)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(x for x in g if x is not None) for g in groups.values())


def test_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(i, f"text {i % 7}", "a", "b", "c", "d") for i in range(100)], SCHEMA)
    got = exact.dedup(docs, 8).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(max(range(k, 100, 7)), len(range(k, 100, 7))) for k in range(7)}
    assert exact.keep_one(docs).count() == 7


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.dedup(none).count() == 0
    assert exact.keep_one(none).count() == 0


def test_deliveries_meet_again(spark):
    """State outlives a run: later deliveries know what earlier ones brought."""
    from veilframe.session import scratch_path

    folder = scratch_path(spark, "deliveries")
    frame = lambda rows: spark.createDataFrame([(i, t, "a", "b", "c", "d") for i, t in rows], SCHEMA)
    first = exact.deliver(frame([(1, "Same"), (5, "other"), (6, None)]), folder).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in first) == [(1, 1, 1, True), (5, 5, 1, True), (6, 6, 1, True)]
    again = exact.deliver(frame([(1, "Same"), (5, "other"), (6, None)]), folder).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in again) == [(1, 1, 2), (5, 5, 2), (6, 6, 2)]
    third = exact.deliver(frame([(3, "sAME"), (0, "OTHER"), (9, "new")]), folder).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in third) == [(0, 5, 3, False), (3, 3, 3, True), (9, 9, 1, True)]


def test_small_batches(spark):
    """Many batches give the state of one."""
    from veilframe.session import scratch_path

    folder = scratch_path(spark, "batches")
    docs = spark.createDataFrame([(i, f"text {i % 7}", "a", "b", "c", "d") for i in range(100)], SCHEMA).repartition(5)
    exact.arrivals(docs, folder)
    held = exact.registry(spark, folder, bytes_per_batch=1).collect()
    assert sorted((r.group_size, r.keep.doc_id) for r in held) == sorted((len(range(k, 100, 7)), max(range(k, 100, 7))) for k in range(7))
