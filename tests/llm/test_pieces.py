"""Sampled segmentations: exact round trips, exact probabilities, reproducibility."""
from collections import Counter

from veilframe.llm import pieces

SCHEMA = "doc_id bigint, text string, pieces string, lossless string"
ODD = [None, "", " ", "  a  b\n\n c ", "▁", "a▁b ▁ ▁▁", "\t\r\n\x0b\x00", "日本語 ñ ü 😀👩‍👩‍👧  ￾", "word " * 40_000, "y" * 3000,
       "\n" * 50, " " * 100, "trailing \n", " nbsp line", "1 2  3   4    5", "é é"]


def test_round_trip(spark, folder):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD)] + [(None, "no id", "x", "y")], SCHEMA)
    found = pieces.encode(docs)
    rows = found.collect()
    assert len(rows) == len(ODD) + 1
    assert all(r.lossless if r.pieces is not None else r.lossless is None for r in rows)
    assert {r.doc_id: r.text for r in pieces.decode(found).collect()} == {**dict(enumerate(ODD)), None: "no id"}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(table.select("doc_id", "text").collect())
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(table)).collect()} == texts


def test_same_sample_anywhere(spark, folder, monkeypatch):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    one = {r.doc_id: r.pieces for r in pieces.encode(table).collect()}
    assert one == {r.doc_id: r.pieces for r in pieces.encode(table.repartition(7)).collect()}
    ids, means, zero = pieces.vocabulary()
    texts = [r.text for r in table.orderBy("doc_id").limit(20).collect()]
    monkeypatch.setattr(pieces, "BLOCK", 100)
    monkeypatch.setattr(pieces, "EDGES", 500)
    small = pieces.encode_batch(texts, list(range(20)), pieces.Lattices(pieces.weights(ids, 1.0), zero), 0)
    assert [x.tolist() for x in small] == [one[i] for i in range(20)]
    other = {r.doc_id: r.pieces for r in pieces.encode(table, seed=1).collect()}
    assert sum(one[i] != other[i] for i in one if one[i]) > 0.9 * len(one)


def test_exact_distribution():
    """Frequencies of whole segmentations match their weights."""
    ids, means, zero = pieces.vocabulary()
    table = pieces.weights(ids, 0.3)
    word = pieces.MARK + "thener"

    def paths(rest):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in table:
                weight, i = table[rest[:n]]
                for tail, w in paths(rest[n:]):
                    yield (i, *tail), weight * w

    weight = dict(paths(word))
    total, n = sum(weight.values()), 40_000
    drawn = pieces.encode_batch(["thener"] * n, list(range(n)), pieces.Lattices(table, zero), 3)
    seen = Counter(tuple(x.tolist()) for x in drawn)
    assert set(seen) <= set(weight) and len(weight) > 10
    for path, w in weight.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4
    # Repeats inside one text are drawn independently.
    inner = pieces.encode_batch(["thener " * 2000], [1], pieces.Lattices(table, zero), 3)[0]
    assert len(set(map(tuple, [inner.tolist()[i:i + 3] for i in range(0, 300, 3)]))) > 5


def test_long_chunk_does_not_lose_range():
    ids, means, zero = pieces.vocabulary()
    lattices = pieces.Lattices(pieces.weights(ids, 1.0), zero)
    for text in ("q" * 5000, "the" * 3000, "😀" * 2000):
        out = pieces.encode_batch([text], [0], lattices, 0)[0]
        assert pieces.decode_ids(out.tolist(), means) == text


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pieces.encode(none).count() == 0 and pieces.decode(pieces.encode(none)).count() == 0
