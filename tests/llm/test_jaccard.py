"""Near copies by five-word shingles against plain pairs."""
import random
from collections import defaultdict

import pytest
from test_simhash import SCHEMA, plain_fingerprint

from veilframe.llm import jaccard, simhash


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_plainly(rows):
    sets, fps, root = [shingles(t) for _, t in rows], [plain_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[find(i)].append(doc)
    return sorted(map(min, groups.values()))


@pytest.mark.parametrize("long", [2, 32])
def test_drops_near_copies(spark, monkeypatch, long):
    monkeypatch.setattr(jaccard, "LONG", long)
    rng, rows = random.Random(4), []
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(6):
            own = list(words)
            for _ in range(rng.randrange(len(words) // 40 + 1)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(900, "a b"), (901, "A b"), (902, ""), (903, "e f g h")]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)
    got = sorted(r.doc_id for r in simhash.keep_one(docs, copies=True).collect())
    assert got == kept_plainly(rows)


def test_pairs_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(1000)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    texts = dict.fromkeys(t for _, t in rows)
    sets = [shingles(t) for t in texts]
    posts = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            posts[x].append(i)
    pairs = {(i, j) for p in posts.values() for i in p for j in p if i < j}
    want = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    bands = [set(jaccard.bands_of(jaccard.shingles_of(t.encode()))) for t in texts]
    bodies = [t.encode() for t in texts]
    assert want and want == {(i, j) for i, j in pairs if bands[i] & bands[j] and jaccard.similar(bodies[i], bodies[j])}
