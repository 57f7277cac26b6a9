"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each later model
also sees the probabilities of the earlier categories. In training those are
out-of-fold predictions, so a later model learns from earlier ones as reliable as
they will be on new texts. Features are hashed distinct words and word
beginnings, so the models need no dictionary.

Models are fitted in numpy on a bounded sample of labelled rows (``SAMPLE``, the
first by hash of doc_id); scoring maps over all whole texts.

Defined results: a null or blank text scores like an empty one; rows whose label is
null are not learned from; a category without both classes in the sample gets its
share as constant probability; with no labels everything is 0 and nothing toxic;
repeated rows score alike; an empty table gives an empty result; other
columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents
from veilframe.llm.registry import query

#: Most labelled rows that models are fitted on.
SAMPLE = 8_000
FOLDS, EPOCHS, RATE, DECAY, DIMENSIONS = 5, 8, 0.1, 1e-5, 1 << 20
#: A feature takes part from this likelihood-ratio statistic (chance: 1 in 1000) and row count.
EVIDENCE, LEAST = 10.8, 3
#: Lengths of word beginnings, in code points.
BEGINNINGS = (3, 5, 7)
_EDGES = b".,;:!?|%&$#*\"'()[]{}<>-_/"
#: Categories in chain order, each a condition on the labels' columns.
CATEGORIES = {
    "low_quality": lambda: F.col("quality") == 0,
    "toxic": lambda: F.col("toxic") == 1,
    "toxic_low_quality": lambda: (F.col("toxic") == 1) & (F.col("quality") == 0),
}
DECIDING = "toxic"


def distinct_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) distinct words without marks at their ends, sorted."""
    return sorted({w.strip(_EDGES) for w in (text or "").encode().lower().split()} - {b""})


def features_of(word: bytes) -> list[int]:
    """Hash numbers of a word and its beginnings."""
    import zlib
    whole, out = word.decode("utf-8", "ignore"), [zlib.crc32(b"w" + word) % DIMENSIONS]
    for n in BEGINNINGS:
        if len(whole) >= n:
            out.append(zlib.crc32(f"b{n}{whole[:n]}".encode()) % DIMENSIONS)
    return out


def telling(rows: list, target, order):
    """Log ratio of each feature's document shares in the two classes; 0 where the
    likelihood-ratio statistic is below ``EVIDENCE`` or fewer than ``LEAST`` rows have it."""
    import numpy as np

    counts = [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)]
    for i in order:
        counts[int(target[i])][np.unique(rows[i])] += 1
    bad, good = float(target[order].sum()), float(len(order) - target[order].sum())
    gain = lambda a: np.where(a > 0, a * np.log(np.maximum(a, 1e-12)), 0.0)
    both, n = counts[0] + counts[1], bad + good
    evidence = 2 * (gain(counts[1]) + gain(counts[0]) + gain(bad - counts[1]) + gain(good - counts[0]) - gain(both) - gain(n - both)
                    - bad * math.log(bad) - good * math.log(good) + n * math.log(n))
    ratio = np.log((counts[1] + 0.5) / (bad + 1)) - np.log((counts[0] + 0.5) / (good + 1))
    return np.where((evidence > EVIDENCE) & (both >= LEAST), ratio, 0.0)


class Linear:
    """Logistic regression over counted hash features and a few dense ones."""

    def __init__(self, dense: int):
        import numpy as np
        self.w, self.dense, self.bias = np.zeros(DIMENSIONS), np.zeros(dense), 0.0

    def fit(self, rows: list, dense, target, order) -> Linear:
        """Adaptive gradient steps over the rows in ``order``, ``EPOCHS`` times.

        Only features that tell the classes apart beyond chance take part, each
        scaled by its log ratio of document shares, so a few telling words
        outweigh a long text's thousands of others.
        """
        import numpy as np
        share = float(np.mean(target[order])) if len(order) else 0.0
        self.bias = math.log((share + 1e-6) / (1 - share + 1e-6))
        if not 0 < share < 1:
            return self
        scale = telling(rows, target, order)
        rows = {i: rows[i][scale[rows[i]] != 0] for i in order}
        w, seen, seen_dense, seen_bias, batch = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-2), np.full(len(self.dense), 1e-2), 1e-2, 16
        for _ in range(EPOCHS):
            for at in range(0, len(order), batch):
                some = order[at:at + batch]
                ids = np.concatenate([rows[i] for i in some])
                owner = np.repeat(np.arange(len(some)), [len(rows[i]) for i in some])
                score = self.bias + np.bincount(owner, w[ids] * scale[ids], len(some)) + dense[some] @ self.dense
                miss = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target[some]
                touched, place = np.unique(ids, return_inverse=True)
                if len(touched):
                    grad = np.bincount(place, miss[owner] * scale[ids]) / len(some) + DECAY * w[touched]
                    seen[touched] += grad * grad
                    w[touched] -= RATE * grad / np.sqrt(seen[touched])
                grad = miss @ dense[some] / len(some)
                seen_dense += grad * grad
                self.dense -= RATE * grad / np.sqrt(seen_dense)
                seen_bias += miss.mean() ** 2
                self.bias -= RATE * miss.mean() / math.sqrt(seen_bias)
        self.w = w * scale
        return self

    def predict(self, rows: list, dense):
        import numpy as np
        words = np.array([self.w[r].sum() for r in rows])
        return 1 / (1 + np.exp(-np.clip(self.bias + words + dense @ self.dense, -30, 30)))


class Chain:
    """Models in chain order and the threshold of the deciding category."""

    def __init__(self, names: list[str]):
        self.names, self.models, self.threshold = names, [], 0.5

    def fit(self, rows: list, targets, folds) -> Chain:
        """``targets`` has a column per category, ``folds`` a fold number per row."""
        import numpy as np
        earlier = np.zeros((len(rows), 0))
        everything = np.arange(len(rows))
        for k, name in enumerate(self.names):
            target, out = targets[:, k], np.zeros(len(rows))
            for fold in range(FOLDS):
                inside = np.flatnonzero(folds == fold)
                if len(inside):
                    model = Linear(k).fit(rows, earlier, target, np.flatnonzero(folds != fold))
                    out[inside] = model.predict([rows[i] for i in inside], earlier[inside])
            self.models.append(Linear(k).fit(rows, earlier, target, everything))
            if name == DECIDING:
                self.threshold = best_threshold(out, target)
            earlier = np.column_stack([earlier, out])
        self.out_of_fold = earlier
        return self

    def of_words(self, sums):
        """Probabilities from each category's summed word weights (a row per text)."""
        import numpy as np
        out = np.zeros((len(sums), 0))
        for k, m in enumerate(self.models):
            score = m.bias + sums[:, k] + out @ m.dense
            out = np.column_stack([out, 1 / (1 + np.exp(-np.clip(score, -30, 30)))])
        return out


def best_threshold(scores, target) -> float:
    """The cut with the best F1, midway to the next lower score."""
    import numpy as np
    if not 0 < target.sum() < len(target):
        return 0.5
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(target[order])
    last = np.append(scores[order][1:] != scores[order][:-1], True)  # cut between different scores only
    f1 = np.where(last, 2 * hits / (np.arange(1, len(order) + 1) + target.sum()), -1)
    at = int(np.argmax(f1))
    below = scores[order[at + 1]] if at + 1 < len(order) else 0.0
    return float((scores[order[at]] + below) / 2)


def learn(docs: DataFrame, labels: DataFrame, categories: dict = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents."""
    import numpy as np
    import pyarrow as pa

    marks = [category().alias(f"c{k}") for k, category in enumerate(categories.values())]
    known = labels.select(F.col("doc_id").alias("_id"), *marks).dropna()
    # One row a document, the most severe label of repeats.
    chosen = known.groupBy("_id").agg(*[F.max(f"c{k}").alias(f"c{k}") for k in range(len(marks))]).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    tags = F.array(*[F.col(f"c{k}") for k in range(len(marks))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[f for w in distinct_words(t.as_py()) for f in features_of(w)] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32())), batch.column(2), batch.column(3)],
                                  names=["doc_id", "ids", "tags", "fold"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS))
    rows = met.select(F.col("doc_id").cast("bigint"), F.col("text"), tags.alias("tags"), fold.alias("fold")).mapInArrow(
        run, "doc_id bigint, ids array<int>, tags array<boolean>, fold bigint")
    # Bounded by the sample, so it may come to the driver; sorted for equal reruns.
    table = rows.toArrow().sort_by("doc_id")
    ids = [np.asarray(x.values) if len(x) else np.empty(0, np.int32) for x in table["ids"]]
    targets = np.array(table["tags"].to_pylist(), np.float64).reshape(len(ids), len(categories))
    return Chain(list(categories)).fit(ids, targets, np.array(table["fold"].to_pylist(), np.int64))


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, the probability of each category and the verdict, for every row."""
    import numpy as np
    import pyarrow as pa

    weights = np.column_stack([m.w for m in chain.models])
    used = np.flatnonzero(weights.any(1))
    rest = [(m.bias, m.dense) for m in chain.models]
    context = docs.sparkSession.sparkContext
    # Bounded by the number of hash features.
    sent = context.broadcast((used.astype(np.int32), weights[used]))
    names = [f"p_{n}" for n in chain.names]
    deciding, threshold, count = chain.names.index(DECIDING), chain.threshold, len(chain.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, values = sent.value
        table = np.zeros((DIMENSIONS, count))
        table[where] = values
        own = Chain(names)
        for bias, dense in rest:
            model = Linear.__new__(Linear)
            model.bias, model.dense = bias, dense
            own.models.append(model)
        number: dict[bytes, int] = {}
        sums: list = []
        for batch in batches:
            totals = np.zeros((batch.num_rows, count))
            for row, text in enumerate(batch.column(1)):
                words, ids = distinct_words(text.as_py()), []
                for w in words:
                    i = number.get(w)
                    if i is None:
                        i = number[w] = len(sums)
                        sums.append(table[features_of(w)].sum(0))
                    ids.append(i)
                if ids:
                    totals[row] = np.sum([sums[i] for i in ids], axis=0)
                if len(sums) > 300_000:  # a memo only, so it may start anew
                    number, sums = {}, []
            p = own.of_words(totals)
            yield pa.record_batch([batch.column(0), *[pa.array(p[:, k]) for k in range(count)], pa.array(p[:, deciding] > threshold)],
                                  names=["doc_id", *names, "toxic"])

    schema = "doc_id bigint, " + "".join(f"{n} double, " for n in names) + "toxic boolean"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


@query("op9_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score(docs, learn(docs, spark.read.parquet(f"{folder}/labels.parquet")))
