"""The classifier chain: held-out accuracy, out-of-fold features, defined cases."""
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from veilframe.llm import toxicity as T
from veilframe.llm.registry import QUERIES

SCHEMA = "doc_id bigint, text string, toxic string, p_toxic string, quality string"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = labels.filter("doc_id % 2 = 0")
    truth = {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    got = {r.doc_id: r for r in T.score(docs, T.learn(docs, half)).collect()}
    assert len(got) == docs.count()
    hit = sum(got[i].toxic and t == 1 for i, t in truth.items())
    named = sum(got[i].toxic for i in truth)
    print("precision", hit / named, "recall", hit / sum(truth.values()))
    assert hit / named > 0.97 and hit / sum(truth.values()) > 0.9


def test_chain_uses_out_of_fold():
    """A later category that follows the earlier one's truth, where words alone say little."""
    rng = np.random.default_rng(0)
    n = 1500
    first = rng.integers(0, 2, n).astype(float)
    rows = [np.array(sorted({int(7 + f), *(100 + rng.integers(0, 400, 5))})) for f in first]
    targets = np.column_stack([first, first])
    folds = np.arange(n) % T.FOLDS
    chain = T.Chain(["low_quality", "toxic"]).fit(rows, targets, folds)
    assert chain.models[1].dense.shape == (1,) and chain.models[1].dense[0] > 0
    for fold in range(T.FOLDS):  # out-of-fold means: from a model that has not seen the fold
        inside = np.flatnonzero(folds == fold)
        model = T.Linear(0).fit(rows, np.zeros((n, 0)), first, np.flatnonzero(folds != fold))
        assert np.allclose(chain.out_of_fold[inside, 0], model.predict([rows[i] for i in inside], np.zeros((len(inside), 0))))


def test_threshold():
    assert 0.3 < T.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0.0])) < 0.8
    assert T.best_threshold(np.array([0.5, 0.5]), np.array([0.0, 0.0])) == 0.5


def test_defined_cases(spark):
    rows = [(i, f"clean words number {i} here", "", "", "") for i in range(60)] + [(i, f"you idiot number {i} here", "", "", "") for i in range(60, 100)]
    rows += [(200, None, "", "", ""), (201, "", "", "", ""), (202, "IDIOT### " * 20_000, "", "", ""), (None, "idiot", "", "", ""), (0, rows[0][1], "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(100)] + [(0, None, None), (None, 1, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = T.score(docs, T.learn(docs, labels)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].toxic == (i >= 60) for i in range(100))
    assert by_id[202].toxic and by_id[None].toxic and not by_id[200].toxic and by_id[200].p_toxic == by_id[201].p_toxic
    none = T.learn(docs, labels.limit(0))
    assert not any(r.toxic for r in T.score(docs, none).collect())
    assert T.score(docs.limit(0), none).count() == 0


def plain_features(text):
    """Hash numbers of a text's distinct words and their beginnings, with repeats."""
    words = sorted({w.strip(b".,;:!?|%&$#*\"'()[]{}<>-_/") for w in (text or "").encode().lower().split()} - {b""})
    out = []
    for w in words:
        out.append(zlib.crc32(b"w" + w) % (1 << 20))
        whole = w.decode("utf-8", "ignore")
        out += [zlib.crc32(f"b{n}{whole[:n]}".encode()) % (1 << 20) for n in (3, 5, 7) if len(whole) >= n]
    return out


def plain_model(rows, dense, target, order):
    """One logistic regression by loops over dictionaries: (weights, dense weights, bias)."""
    share = sum(target[i] for i in order) / len(order)
    bias, width = math.log((share + 1e-6) / (1 - share + 1e-6)), len(dense[0])
    if not 0 < share < 1:
        return {}, [0.0] * width, bias
    counts = {}
    for i in order:
        for f in set(rows[i]):
            counts.setdefault(f, [0, 0])[int(target[i])] += 1
    bad = sum(target[i] for i in order)
    good, g = len(order) - bad, lambda a: a * math.log(a) if a > 0 else 0.0
    scale = {}
    for f, (c, b) in counts.items():
        n = bad + good
        evidence = 2 * (g(b) + g(c) + g(bad - b) + g(good - c) - g(b + c) - g(n - b - c) - g(bad) - g(good) + g(n))
        if evidence > 10.8 and b + c >= 3:
            scale[f] = math.log((b + .5) / (bad + 1)) - math.log((c + .5) / (good + 1))
    w, seen, v, seen_v, seen_bias = {}, {}, [0.0] * width, [1e-2] * width, 1e-2
    for _ in range(8):
        for at in range(0, len(order), 16):
            some, grad, grad_v, total = order[at:at + 16], {}, [0.0] * width, 0.0
            for i in some:
                s = bias + sum(w.get(f, 0.0) * scale[f] for f in rows[i] if scale.get(f)) + sum(a * b for a, b in zip(dense[i], v))
                miss = 1 / (1 + math.exp(-min(30, max(-30, s)))) - target[i]
                total += miss
                for f in rows[i]:
                    if scale.get(f):
                        grad[f] = grad.get(f, 0.0) + miss * scale[f]
                grad_v = [x + miss * d for x, d in zip(grad_v, dense[i])]
            for f, x in grad.items():
                x = x / len(some) + 1e-5 * w.get(f, 0.0)
                seen[f] = seen.get(f, 1e-2) + x * x
                w[f] = w.get(f, 0.0) - 0.1 * x / math.sqrt(seen[f])
            for k, x in enumerate(grad_v):
                seen_v[k] += (x / len(some)) ** 2
                v[k] -= 0.1 * x / len(some) / math.sqrt(seen_v[k])
            seen_bias += (total / len(some)) ** 2
            bias -= 0.1 * total / len(some) / math.sqrt(seen_bias)
    return {f: x * scale[f] for f, x in w.items()}, v, bias


def plain_probability(model, row, dense):
    w, v, bias = model
    s = bias + sum(w.get(f, 0.0) for f in row) + sum(a * b for a, b in zip(dense, v))
    return 1 / (1 + math.exp(-min(30, max(-30, s))))


def test_query_like_a_plain_chain(spark, folder):
    """The whole query against dictionaries and loops: probabilities and verdicts of every row."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rated = {r.doc_id: (float(r.quality == 0), float(r.toxic == 1), float(r.toxic == 1 and r.quality == 0)) for r in labels.collect() if r.doc_id in text}
    fold_of = {r.doc_id: r.fold for r in docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.lit("fold")), F.lit(5)).alias("fold")).collect()}
    ids = sorted(rated)
    rows, folds = [plain_features(text[i]) for i in ids], [fold_of[i] for i in ids]
    dense, models, deciding = [[] for _ in ids], [], None
    for k in range(3):
        target, out = [rated[i][k] for i in ids], [0.0] * len(ids)
        for fold in range(5):
            outside = [i for i in range(len(ids)) if folds[i] != fold]
            model = plain_model(rows, dense, target, outside)
            for i in (i for i in range(len(ids)) if folds[i] == fold):
                out[i] = plain_probability(model, rows[i], dense[i])
        models.append(plain_model(rows, dense, target, list(range(len(ids)))))
        if k == 1:
            f1 = lambda cut: 2 * sum(t for s, t in zip(out, target) if s >= cut) / (sum(s >= cut for s in out) + sum(target))
            cut = max(sorted(set(out), reverse=True), key=f1)
            deciding = (cut + max((s for s in out if s < cut), default=0.0)) / 2
        dense = [[*d, p] for d, p in zip(dense, out)]
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, folder).collect()}
    assert len(got) == len(text) and sum(r[1] for r in rated.values()) > 3
    for i, t in text.items():
        p, row = [], plain_features(t)
        for m in models:
            p.append(plain_probability(m, row, p))
        assert np.allclose([got[i].p_low_quality, got[i].p_toxic, got[i].p_toxic_low_quality], p, atol=1e-6), i
        assert got[i].toxic == (p[1] > deciding) or abs(p[1] - deciding) < 1e-6
