"""The recurrent language model against plain counts, its own sums and gradients."""
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from veilframe.llm import recurrent as R

SCHEMA = "doc_id bigint, text string, held_out string, n string, score string"


def split(text):
    return (text or "").encode().lower().split()


def plain(rows):
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            c.update(split(t))
            c[b""] += 1
    total, distinct = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        words = [*split(t), b""]
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words)
        out.append((i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(words), sum(c[w] > 0 for w in words), total, base))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9), (g, w)
    return got


@pytest.mark.parametrize("words", [131_072, 300])
def test_base_and_gain(spark, monkeypatch, words):
    monkeypatch.setattr(R, "WORDS", words)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = same(R.score(docs).collect(), plain(rows))
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    for held in (False, True):
        per = [sum(g[k] for g in got if g[1] == held) / sum(g[2] for g in got if g[1] == held) for k in (5, 6)]
        assert per[1] > per[0] + 0.02, per  # better than the unigram base, on held-out texts too


def test_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(R, "HEAD_CLASSES", 2)
    monkeypatch.setattr(R, "CLASS_WORDS", 3)
    words = [(b"", 9)] + [(b"w%d" % i, 30 - i) for i in range(20)]
    d = R.Dictionary(words, sum(n for _, n in words) + 12, len(words) + 4)
    p = R.initial(d)
    rng = np.random.default_rng(0)
    for k in p:
        p[k] = (p[k] + rng.standard_normal(p[k].shape) * (0.3 if k != "w" else 0)).astype(np.float32)
    before = [3, 7, -1, 0]
    mass = 0.0
    for i in range(len(words)):
        mass += 10 ** (R.score_texts(p, d, [[*before, i]])[0] - R.score_texts(p, d, [before])[0])
    outside = 10 ** (R.score_texts(p, d, [[*before, -1]])[0] - R.score_texts(p, d, [before])[0])
    # Four words with 12 counts between them and one unseen share the outside class.
    inside = sum((n + 1) / (d.rest_n + d.rest_v + 1) for n in (3, 3, 3, 3)) + 1 / (d.rest_n + d.rest_v + 1)
    assert math.isclose(mass + outside * inside, 1.0, rel_tol=1e-4)


def test_gradients(monkeypatch):
    monkeypatch.setattr(R, "HEAD_CLASSES", 2)
    monkeypatch.setattr(R, "CLASS_WORDS", 4)
    words = [(b"", 9)] + [(b"w%d" % i, 40 - i) for i in range(15)]
    d = R.Dictionary(words, 700, 20)
    rng = np.random.default_rng(1)
    p = {k: w.astype(np.float64) + (rng.standard_normal(w.shape) * 0.2 if k != "w" else 0) for k, w in R.initial(d).items()}
    x, y = rng.integers(-1, 16, (5, 3)), rng.integers(-1, 16, (5, 3))

    def loss(grads=None):
        states, kept = R.forward(p, d.inp[x], np.zeros((3, R.HIDDEN)))
        flat = states.reshape(-1, R.HIDDEN)
        logp, back = R.outputs(p, flat, d.cls[y.ravel()], d.slot[y.ravel()], grads)
        if grads is not None:
            R.backward(p, d.inp[x], kept, back.reshape(states.shape), grads)
        return -float(logp.sum())

    grads = {k: np.zeros_like(w) for k, w in p.items()}
    loss(grads)
    for k in p:
        for at in rng.integers(0, p[k].size, 12):
            if p[k].flat[at] < -1e6:
                continue
            was = p[k].flat[at]
            p[k].flat[at] = was + 1e-2
            up = loss()
            p[k].flat[at] = was - 1e-2
            down = loss()
            p[k].flat[at] = was
            assert math.isclose((up - down) / 2e-2, grads[k].flat[at], rel_tol=2e-2, abs_tol=2e-3), k


def test_windows_carry_state():
    words = [(b"", 50)] + [(b"w%d" % i, 400 - i) for i in range(200)]
    d = R.Dictionary(words, sum(n for _, n in words), len(words))
    p = R.initial(d)
    p["C"] += np.random.default_rng(2).standard_normal(p["C"].shape).astype(np.float32)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 200, n).tolist() for n in (1, 31, 32, 33, 150, 7, 64)]
    whole = R.score_texts(p, d, texts)
    for t, s in zip(texts, whole):
        x = np.array([d.number[b""], *t[:-1]])[:, None]
        states, _ = R.forward(p, d.inp[x], np.zeros((1, R.HIDDEN), np.float32))
        logp, _ = R.outputs(p, states[:, 0], d.cls[t], d.slot[t])
        assert math.isclose(s, float((logp / math.log(10) + d.within[t]).sum()), rel_tol=1e-4)


def test_learns_order(spark):
    """Words that follow each other in turn score far above their frequencies."""
    rows = [(i, " ".join(f"k{(i + j) % 9}" for j in range(60 + i % 5))) for i in range(3000)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    got = R.score(docs).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_defined_cases(spark):
    rows = [(0, None), (1, ""), (2, " \n"), (None, "A a É é"), (4, "x" * 10_000), (5, "dup dup"), (5, "dup dup"), (6, "w " * 5000)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    same(R.score(docs).collect(), plain(rows))
    assert R.score(docs.limit(0)).count() == 0
    only = docs.filter(R.held_out())
    kept = [(r.doc_id, r.text) for r in only.collect()]
    same(R.score(only).collect(), plain(kept))


def test_every_training_token_is_a_target(spark):
    rows = [(i, " ".join(f"w{(i * j) % 11}" for j in range(n))) for i, n in enumerate([0, 1, 5, 127, 128, 129, 300, 2, 3, 1000])]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    cut = R._rows(docs)
    d = R.dictionary(R.counts(cut))
    found = Counter(t for r in R.spans(cut, d).collect() for t in r.ids[1:])
    want = Counter(d.numbers([w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*split(t), b""]]))
    assert found == want and sum(want.values()) == d.total


def test_texts_are_numbered_once(spark):
    """What is written of a text serves training and scoring: its words need not be found again."""
    rows = [(i, t) for i, t in enumerate([None, "", "a b a", "B c " * 200, "rare", "a"])]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    cut = R._rows(docs)
    words = [(b"", 6), (b"a", 4), (b"b", 2)]
    d = R.Dictionary(words, 600, 5)
    got = {r.doc_id: r for r in R.numbered(cut, d).collect()}
    for i, t in rows:
        assert got[i].ids == [d.number.get(w, -1) for w in [*split(t), b""]]
        assert {bytes(o.token): o.times for o in got[i].outside} == Counter(w for w in split(t) if w not in d.number)
        assert got[i].n_out == got[i].ids.count(-1) and got[i].base == pytest.approx(sum(d.base[w] for w in got[i].ids))


def test_lists_and_arrays():
    lists = [np.arange(n, dtype=np.int32) for n in (3, 0, 5, 1)]
    column = R._lists(lists)
    assert [a.tolist() for a in R._arrays(column)] == [a.tolist() for a in lists]
    assert [a.tolist() for a in R._arrays(column.slice(1, 2))] == [a.tolist() for a in lists[1:3]]
    assert R._arrays(column.slice(0, 0)) == [] and len(R._lists([])) == 0


def test_score_does_not_depend_on_company(monkeypatch):
    words = [(b"", 50)] + [(b"w%d" % i, 400 - i) for i in range(200)]
    d = R.Dictionary(words, sum(n for _, n in words), len(words))
    p = R.initial(d)
    rng = np.random.default_rng(5)
    p["C"] += rng.standard_normal(p["C"].shape).astype(np.float32)
    texts = [rng.integers(-1, 200, n) for n in (1, 40, 700, 3, 64, 65, 31)]
    whole = R.score_texts(p, d, texts)
    monkeypatch.setattr(R, "SIDE_BY_SIDE", 2)
    assert np.allclose(R.score_texts(p, d, texts), whole, rtol=1e-5)


def test_following_gives_the_states_of_training():
    words = [(b"", 50)] + [(b"w%d" % i, 400 - i) for i in range(200)]
    d = R.Dictionary(words, sum(n for _, n in words), len(words))
    p = R.initial(d)
    rng = np.random.default_rng(6)
    for steps, rows in ((1, 1), (32, 64), (7, 5)):
        x, h = d.inp[rng.integers(-1, 200, (steps, rows))], rng.standard_normal((rows, R.HIDDEN)).astype(np.float32)
        assert np.allclose(R.follow(p, x, h), R.forward(p, x, h)[0], rtol=1e-5, atol=1e-6)


def test_rows_are_added_by_key():
    rng = np.random.default_rng(7)
    for n, keys in ((1, 1), (40, 1), (500, 3), (500, 400), (2048, 60)):
        at, rows, got = rng.integers(0, keys, n), rng.standard_normal((n, 6)), np.ones((keys, 6))
        want = got.copy()
        np.add.at(want, at, rows)
        R._add_rows(got, at, rows)
        assert np.allclose(got, want)


@pytest.mark.parametrize("shift", [0, 300, -300])
def test_choices_far_from_zero(shift):
    """What all choices have in common changes nothing, also where its exponential has no number."""
    words = [(b"", 50)] + [(b"w%d" % i, 400 - i) for i in range(200)]
    d = R.Dictionary(words, sum(n for _, n in words), len(words))
    p = R.initial(d)
    rng = np.random.default_rng(8)
    p["C"] += rng.standard_normal(p["C"].shape).astype(np.float32)
    states, y = rng.standard_normal((50, R.HIDDEN)).astype(np.float32), rng.integers(-1, 200, 50)
    results = []
    for by in (0, shift):
        own = {k: w + np.float32(by if k in "cw" else 0) for k, w in p.items()}
        grads = {k: np.zeros_like(w) for k, w in p.items()}
        results.append((*R.outputs(own, states, d.cls[y], d.slot[y], grads), *grads.values()))
    for a, b in zip(*results):
        assert np.isfinite(b).all() and np.allclose(a, b, atol=2e-3)


def test_training_equals_plain_steps(monkeypatch):
    """Weights after training against one token, one row and one weight array at a time."""
    monkeypatch.setattr(R, "HEAD_CLASSES", 2)
    monkeypatch.setattr(R, "CLASS_WORDS", 4)
    words = [(b"", 9)] + [(b"w%d" % i, 40 - i) for i in range(15)]
    d = R.Dictionary(words, 700, 20)
    rng = np.random.default_rng(9)
    spans = [rng.integers(-1, 16, n) for n in (2, 129, 40, 33, 34, 70)]
    k, got = R.HIDDEN, R.initial(d)
    p = {n: w.astype(np.float64) for n, w in got.items()}
    m, v = ({n: np.zeros_like(w) for n, w in p.items()} for _ in range(2))
    assert R.train(got, spans, d) == sum(len(s) - 1 for s in spans)

    def softmax(a):
        e = np.exp(a - a.max())
        return e / e.sum()

    h = {i: np.zeros(k) for i in range(len(spans))}
    for t, at in enumerate(range(0, 128, R.WINDOW), 1):
        g, met = {n: np.zeros_like(w) for n, w in p.items()}, 0
        for i, s in enumerate(spans):
            kept = []
            for x, y in zip(d.inp[s[at:at + R.WINDOW]], s[at + 1:at + 1 + R.WINDOW]):
                a, u = p["E"][x], h[i] @ p["U"]
                r, z = (1 / (1 + np.exp(-(a + u)[part])) for part in (slice(0, k), slice(k, 2 * k)))
                n = np.tanh(a[2 * k:] + r * u[2 * k:])
                kept.append((x, y, h[i], r, z, n, u[2 * k:]))
                h[i] = (1 - z) * n + z * h[i]
            dh = np.zeros(k)
            for j, (x, y, before, r, z, n, un) in reversed(list(enumerate(kept))):
                after, c, w = (1 - z) * n + z * before, d.cls[y], d.slot[y]
                soft = softmax(after @ p["C"] + p["c"])
                soft[c] -= 1
                g["C"] += np.outer(after, soft)
                g["c"] += soft
                dh = dh + p["C"] @ soft
                if w >= 0:
                    soft = softmax(after @ p["W"][c] + p["w"][c])
                    soft[w] -= 1
                    g["W"][c] += np.outer(after, soft)
                    g["w"][c] += soft
                    dh = dh + p["W"][c] @ soft
                dn = dh * (1 - z) * (1 - n * n)
                gates = np.concatenate([dn * un * r * (1 - r), dh * (before - n) * z * (1 - z), dn])
                g["E"][x] += gates
                gates[2 * k:] *= r
                g["U"] += np.outer(before, gates)
                dh = dh * z + p["U"] @ gates
                met += 1
        norm = math.sqrt(sum(float((w * w).sum()) for w in g.values())) / met
        for name, w in g.items():
            w = w * min(1, 1 / norm) / met
            m[name] = 0.9 * m[name] + 0.1 * w
            v[name] = 0.99 * v[name] + 0.01 * w * w
            p[name] = p[name] - R.LEARNING_RATE * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-6)
    for name in p:
        assert np.allclose(got[name], p[name], atol=2e-4), name
