"""SimHash near-dedup against plain pairs."""
import random
import re
from collections import defaultdict

import pytest
import xxhash

from veilframe.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, body string, root string"


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    """Smallest id of the component of each (id, fingerprint)."""
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = defaultdict(list)
    for i, f in fps.items():
        least[find(f)].append(i)
    return {i: min(least[find(f)]) for i, f in fps.items()}


def test_whole_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = plain_groups(fps)
    got = simhash.near_dups(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("long", [2, 32])
def test_links_of_planted_fingerprints(spark, monkeypatch, long):
    """Chains and balls of fingerprints, by pairs and by neighbour lists."""
    monkeypatch.setattr(simhash, "LONG", long)
    rng = random.Random(5)
    values = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            values.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << b) for b in range(64)} | {0, 1, 3, (1 << 64) - 1}
    fps = dict(enumerate(sorted(values)))
    signed = lambda f: f - (1 << 64) if f >= 1 << 63 else f
    nodes = spark.createDataFrame([(signed(f),) for f in fps.values()], "fp bigint")
    edges = simhash.links(nodes).collect()
    assert all(((e.a ^ e.b) & ((1 << 64) - 1)).bit_count() <= 2 for e in edges)
    root = dict(simhash.components(simhash.links(nodes)).collect())
    groups = defaultdict(set)
    for i, f in fps.items():
        groups[root.get(signed(f), signed(f))].add(i)
    want = plain_groups(fps)
    expected = defaultdict(set)
    for i, r in want.items():
        expected[r].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_tally_decides(spark):
    """The tally keeps exactly the pairs with six or more equal positional bytes."""
    rng = random.Random(9)
    base = [rng.randbytes(8) for _ in range(12)]
    values = set(base)
    for x in base:
        for n in (1, 2, 3, 3, 4, 4):
            y = bytearray(x)
            for at in rng.sample(range(8), n):
                y[at] ^= rng.randrange(1, 256)
            values.add(bytes(y))
    shared = {(a, b): sum(p == q for p, q in zip(a, b)) for a in values for b in values if a < b}
    number = lambda x: int.from_bytes(x, "little", signed=True)
    nodes = spark.createDataFrame([(number(x),) for x in values], "fp bigint")
    got = {frozenset((r.a, r.b)): r.shared for r in simhash.tallied(simhash.postings(nodes)).collect()}
    want = {frozenset(map(number, pair)): n for pair, n in shared.items() if n >= 6}
    assert {pair: n for pair, n in got.items() if n >= 6} == want
    # Pairs with four or five equal bytes meet in a posting and go by their tally.
    assert len(got) > len(want) + 20
    assert {n for pair, n in got.items() if pair not in want} == {4}


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (None, "one two"), (5, "one TWO"), (6, "É a b"), (7, "é a b"),
            (8, "w " * 60_000), (9, "w " * 50), (None, "nobody else says this")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = simhash.near_dups(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{plain_fingerprint(t):016x}") for i, t in rows}
    named = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    fp = lambda t: f"{plain_fingerprint(t):016x}"
    assert [named[i, fp(None)] for i in (1, 2, 3)] == [1, 1, 1]
    assert named[None, fp("one two")] == named[5, fp("one two")] == 4 and named[9, fp("w w w")] == 8
    assert named[None, fp(rows[-1][1])] is None
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 4, 6, 7, 8, None]
    repeated = spark.createDataFrame([(1, "a b c", "x", "y", "z")] * 4, SCHEMA)
    assert simhash.keep_one(repeated).count() == 1
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_dups(none).count() == 0 and simhash.keep_one(none).count() == 0
