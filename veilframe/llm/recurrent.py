"""Scoring texts with a gated recurrent language model.

Counts of all tokens of all training texts give the base score and the output
classes. The output softmax is factored by class: head classes hold the most
frequent words and choose among them by a softmax on the state; tail classes
hold words of like frequency, chosen by their counts; the last class holds
words outside the bounded dictionary and anything unseen. The probabilities
of all words, and one for the unseen, sum to one.

The network (gated recurrent units, numpy) starts as the unigram model and is
trained by truncated backpropagation through time: windows of ``WINDOW`` tokens,
state carried from window to window. All training texts are cut into spans and
every span is trained on; a keyed hash deals them to shards of bounded size, which
train copies in parallel, whose weights are averaged by Spark.

Scoring runs each whole text in windows, the state carried across them.
Every text is turned into word numbers once, for training and scoring; dictionary
words are looked up in place (the dictionary has at most ``WORDS`` entries), other
words are joined with the counts in a shuffle.

Defined results: a null text counts as empty, whose only token is the end;
a null doc_id hashes as empty text; repeated rows are scored alike and each
counts in training; with no training texts every probability is that of the one
unseen word; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import documents
from veilframe.llm.registry import query
from veilframe.session import checkpoint

#: Most words in the dictionary that every task holds (a few MB).
WORDS = 131_072
HEAD_CLASSES, CLASS_WORDS, TAIL_CLASSES = 32, 32, 15
HIDDEN = 24
WINDOW, SPAN = 32, 128
SHARD_SPANS = 32_768
ROUNDS, LEARNING_RATE, BATCH = 1, 0.015, 64
#: Texts that are scored together, few enough for the processor's cache.
SIDE_BY_SIDE = 512
END = b""


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("body"),
                       held_out().alias("held_out"))


def tokens(body: bytes) -> list[bytes]:
    """Lower-cased words; both functions know ASCII only, as the definition does."""
    return body.lower().split()


def counts(rows: DataFrame) -> DataFrame:
    """(token, n) over the training texts; the end is the empty token.

    Tasks send partial counts whenever they hold many distinct tokens.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        found: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "n"])
            found.clear()
            return out

        for batch in batches:
            for body in batch.column(0):
                found.update(tokens(body.as_py()))
                found[END] += 1
                if len(found) > 500_000:
                    yield sent()
        yield sent()

    partial = rows.filter("not held_out").select("body").mapInArrow(run, "token binary, n bigint")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


class Dictionary:
    """The frequent words with their classes, and what scoring needs of each.

    Arrays are indexed by word number; the last entry is the word outside.
    """

    def __init__(self, words: list[tuple[bytes, int]], total: int, distinct: int):
        import numpy as np

        words = sorted(words, key=lambda w: (w[0] != END, -w[1], w[0]))
        self.number = {w: i for i, (w, _) in enumerate(words)}
        n = np.array([c for _, c in words] + [0], np.float64)
        self.total, self.distinct = total, distinct
        head = min(len(words), HEAD_CLASSES * CLASS_WORDS)
        self.heads = -(-head // CLASS_WORDS)
        size = len(words) + 1
        self.cls, self.slot, self.inp = np.empty(size, np.int32), np.full(size, -1, np.int32), np.empty(size, np.int32)
        rank = np.arange(head)
        self.cls[:head], self.slot[:head], self.inp[:head] = rank // CLASS_WORDS, rank % CLASS_WORDS, rank
        # Tail classes of about equal mass, by falling count.
        tail = n[head:-1]
        mass = np.cumsum(tail) - tail
        part = np.minimum(TAIL_CLASSES - 1, (mass * TAIL_CLASSES / max(tail.sum(), 1)).astype(np.int32))
        self.tails = int(part.max()) + 1 if len(part) else 0
        self.cls[head:-1], self.inp[head:-1] = self.heads + part, head + part
        self.outside = self.heads + self.tails
        self.cls[-1], self.inp[-1] = self.outside, head + self.tails
        self.classes, self.inputs, self.head = self.outside + 1, head + self.tails + 1, head
        in_class = np.bincount(self.cls[:-1], n[:-1], self.classes)
        #: log10 of the word within its class, for tail words.
        self.within = np.zeros(size)
        self.within[head:-1] = np.log10(tail / in_class[self.cls[head:-1]])
        self.rest_n, self.rest_v = total - int(n.sum()), distinct - len(words)
        self.base = np.log10((n + 1) / (total + distinct + 1))
        self.base[-1] = 0.0
        in_class[-1] = self.rest_n + 1
        self.class_bias = np.log(in_class / in_class.sum()).astype(np.float32)
        self.word_bias = np.full((max(self.heads, 1), CLASS_WORDS), -1e9, np.float32)
        self.word_bias.flat[:head] = np.log(n[:head])

    def numbers(self, words: list[bytes]) -> list[int]:
        return self.array(words).tolist()

    def array(self, words: list[bytes]):
        """The words' numbers, which go into the array as they are found."""
        import numpy as np
        return np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int32, len(words))


def dictionary(table: DataFrame) -> Dictionary:
    """The most frequent words, at most ``WORDS``, cut at a step of the count's logarithm."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = table.groupBy(step.alias("s")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).orderBy(F.col("s").desc()).collect()
    held, lowest = 0, 1 << 30
    for r in sizes:
        if held + r["v"] >= WORDS:
            break
        held, lowest = held + r["v"], r["s"]
    words = table.filter((step >= lowest) | (F.col("token") == F.lit(END))).collect()
    return Dictionary([(bytes(r["token"]), r["n"]) for r in words], sum(r["n"] for r in sizes), sum(r["v"] for r in sizes))


def initial(d: Dictionary) -> dict:
    """Weights that make the network the unigram model over classes and words."""
    import numpy as np

    rng = np.random.default_rng(7)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"E": small(d.inputs, 3 * HIDDEN), "U": small(HIDDEN, 3 * HIDDEN), "C": np.zeros((HIDDEN, d.classes), np.float32), "c": d.class_bias.copy(),
            "W": np.zeros((max(d.heads, 1), HIDDEN, CLASS_WORDS), np.float32), "w": d.word_bias.copy()}


def forward(p: dict, x, h):
    """States after each input (steps first), and what the way back needs.

    Rows lie along memory and gates one behind the other, so that one product gives all
    gates of a step and each gate is one stretch of memory.
    """
    import numpy as np

    k, steps, rows = HIDDEN, len(x), len(h)
    # The gates want the exponential of the negative.
    weights = p["U"].T.copy()
    np.negative(weights[:2 * k], out=weights[:2 * k])
    few = 8  # steps that stay in the processor's cache
    g, a = np.empty((steps, 3 * k, rows), h.dtype), np.empty((few, 3 * k, rows), h.dtype)
    states, n = (np.empty((steps, k, rows), h.dtype) for _ in range(2))
    before = first = np.ascontiguousarray(h.T)
    for t, (both, new, after) in enumerate(zip(g, n, states)):
        if t % few == 0:
            met = p["E"].take(x[t:t + few], axis=0, mode="clip").transpose(0, 2, 1)
            np.negative(met[:, :2 * k], out=a[:len(met), :2 * k])
            a[:len(met), 2 * k:] = met[:, 2 * k:]
        own = a[t % few]
        np.dot(weights, before, out=both)
        gates = both[:2 * k]
        gates += own[:2 * k]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(both[:k], both[2 * k:], out=new)
        new += own[2 * k:]
        np.tanh(new, out=new)
        np.subtract(before, new, out=after)
        after *= both[k:2 * k]
        after += new
        before = after
    return states.transpose(0, 2, 1), (first, states, g, n)


def follow(p: dict, x, h):
    """The same states where nothing goes back: many rows at once, inputs taken gate by gate."""
    import numpy as np

    k, steps, rows = HIDDEN, len(x), len(h)
    inputs = np.ascontiguousarray(p["E"].reshape(-1, 3, k).transpose(1, 0, 2))
    weights = np.ascontiguousarray(p["U"].reshape(k, 3, k).transpose(1, 0, 2))
    np.negative(inputs[:2], out=inputs[:2])
    np.negative(weights[:2], out=weights[:2])
    states = np.empty((steps, rows, k), h.dtype)
    a, g = (np.empty((3, rows, k), h.dtype) for _ in range(2))
    gates, n = g[:2], g[2]
    before = h
    for own, after in zip(x, states):
        inputs.take(own, axis=1, out=a, mode="clip")
        np.matmul(before, weights, out=g)
        gates += a[:2]
        np.exp(gates, out=gates)
        gates += 1
        n /= gates[0]
        n += a[2]
        np.tanh(n, out=n)
        np.subtract(before, n, out=after)
        after /= gates[1]
        after += n
        before = after
    return states


def outputs(p: dict, states, cls, slot, grads: dict | None = None):
    """Natural log probability of each target's class times head word; with
    ``grads``, also adds the output weights' gradients and returns the states'.

    Choices lie in rows and tokens in columns, so sums over choices run along memory.
    A one behind every state makes the biases part of the products.
    """
    import numpy as np

    k = HIDDEN
    logp = np.empty(len(states), states.dtype)
    back = None if grads is None else np.empty_like(states)
    turned = np.concatenate([p["C"].T, p["c"][:, None]], 1)
    words = np.concatenate([p["W"].transpose(0, 2, 1), p["w"][:, :, None]], 2)

    def choose(soft, target):
        """Log probabilities of the targets; with ``grads``, ``soft`` becomes the gradient."""
        at = target, np.arange(len(target))
        top = soft.max(0)
        if not (top.max() < 60 and top.min() > -60):  # exponentials might leave their range
            soft -= top
        chosen = soft[at]
        np.exp(soft, out=soft)
        whole = soft.sum(0)
        chosen -= np.log(whole)
        if grads is not None:
            soft *= np.reciprocal(whole, out=whole)
            soft[at] -= 1
        return chosen

    for at in range(0, len(states), 4096):  # blocks that stay in the processor's cache
        some = slice(at, at + 4096)
        want, place = cls[some], slot[some]
        own = np.empty((len(want), k + 1), states.dtype)
        own[:, :k], own[:, k] = states[some], 1
        soft = turned @ own.T
        logp[some] = choose(soft, want)
        if grads is not None:
            met = soft @ own
            grads["C"] += met[:, :k].T
            grads["c"] += met[:, k]
            np.matmul(soft.T, turned[:, :k], out=back[some])
        # Words of the head classes, class by class.
        order = np.argsort(want.astype(np.int16), kind="stable")
        order = order[place.take(order) >= 0]
        if not len(order):
            continue
        own, want, place = own.take(order, axis=0), want.take(order), place.take(order)
        starts = np.flatnonzero(np.diff(want, prepend=-1))
        parts = [slice(*ends) for ends in itertools.pairwise([*starts.tolist(), len(order)])]
        classes = want[starts].tolist()
        soft, turned_own = np.empty((words.shape[1], len(order)), states.dtype), own.T
        for c, part in zip(classes, parts):
            np.matmul(words[c], turned_own[:, part], out=soft[:, part])
        logp[some][order] += choose(soft, place)
        if grads is not None:
            more, met = np.empty((len(order), k), states.dtype), np.empty((len(classes), len(soft), k + 1), states.dtype)
            turned_soft, plain = soft.T, words[:, :, :k]
            for c, part, sums in zip(classes, parts, met):
                np.matmul(soft[:, part], own[part], out=sums)
                np.matmul(turned_soft[part], plain[c], out=more[part])
            grads["W"][classes] += met[:, :, :k].transpose(0, 2, 1)
            grads["w"][classes] += met[:, :, k]
            back[some][order] += more
    return logp, back


def _add_rows(into, keys, rows) -> None:
    """Add every row to the entry of its key.

    The first rows of all keys are added at once, then the second ones, and so on; of keys
    with many rows the rest is summed key by key.
    """
    import numpy as np

    order = np.argsort(keys.astype(np.int16), kind="stable")
    starts = np.flatnonzero(np.diff(keys.take(order), prepend=-1))
    times = np.diff(starts, append=len(keys))
    by = np.argsort(-times, kind="stable")
    starts, times, layers = starts.take(by), times.take(by), 12
    sums = rows.take(order.take(starts), axis=0)
    left = np.searchsorted(-times, -np.arange(layers + 1)).tolist()
    for nth in range(1, layers):
        n = left[nth]
        if not n:
            break
        sums[:n] += rows.take(order.take(starts[:n] + nth), axis=0)
    ones = np.ones(len(keys), rows.dtype)
    for own, at, n in zip(sums[:left[layers]], starts.tolist(), times.tolist()):
        own += ones[layers:n] @ rows.take(order[at + layers:at + n], axis=0)
    into[keys.take(order.take(starts))] += sums


def backward(p: dict, x, kept, back, grads: dict) -> None:
    """Gradients through one window; they stop at its beginning."""
    import numpy as np

    k, (first, states, g, n) = HIDDEN, kept
    steps, _, rows = states.shape
    before = np.concatenate([first[None], states[:-1]])
    # What the gradient of a state is multiplied by, for all steps at once: for the gates r and z,
    # the recurrent part of n, the state before, the whole of n.
    factors, products = np.empty((5, steps, k, rows), n.dtype), np.empty((steps, 5, k, rows), n.dtype)
    by_r, by_z, by_new, z, by_n = factors
    z[...] = g[:, k:2 * k]
    open_ = 1 - z
    np.subtract(states, n, out=by_z)
    by_z *= open_
    np.multiply(n, n, out=by_n)
    np.subtract(1, by_n, out=by_n)
    by_n *= open_
    r = np.ascontiguousarray(g[:, :k])
    np.multiply(by_n, r, out=by_new)
    np.subtract(1, r, out=by_r)
    by_r *= g[:, 2 * k:]
    by_r *= by_new
    # One product carries the gradient to the state before, over the gates and directly.
    turned = np.concatenate([p["U"], np.eye(k, dtype=n.dtype)], 1)
    back = np.ascontiguousarray(back.transpose(0, 2, 1))
    dh = np.zeros((k, rows), n.dtype)
    flat = products.reshape(steps, 5 * k, rows)
    for t in range(steps - 1, -1, -1):
        dh += back[t]
        np.multiply(factors[:, t], dh, out=products[t])
        np.dot(turned, flat[t, :4 * k], out=dh)
    own = flat[:, :3 * k].transpose(0, 2, 1)
    grads["U"] += np.matmul(before, own).sum(0)
    per_row = np.empty((steps, rows, 3 * k), n.dtype)
    per_row[:, :, :2 * k] = own[:, :, :2 * k]
    per_row[:, :, 2 * k:] = flat[:, 4 * k:].transpose(0, 2, 1)
    _add_rows(grads["E"], np.asarray(x).ravel(), per_row.reshape(-1, 3 * k))


def _views(flat, p: dict) -> dict:
    """Arrays of the shapes of ``p`` over one stretch of memory."""
    views, at = {}, 0
    for k, w in p.items():
        views[k] = flat[at:at + w.size].reshape(w.shape)
        at += w.size
    return views


class Adam:
    """Weights, and room for their gradients, each in one stretch of memory."""

    def __init__(self, p: dict):
        import numpy as np
        self.flat, self.t = np.concatenate([w.ravel() for w in p.values()]), 0
        self.grad, self.m, self.v, self.spare = (np.zeros_like(self.flat) for _ in range(4))
        self.p, self.grads = _views(self.flat, p), _views(self.grad, p)

    def step(self, tokens: int) -> None:
        """Take one step and clear the gradients, in blocks that stay in the processor's cache."""
        import numpy as np
        self.t += 1
        norm = math.sqrt(float(self.grad @ self.grad)) / tokens
        scale = 0.1 * min(1.0, 1.0 / max(norm, 1e-12)) / tokens
        root = math.sqrt(1 - 0.99**self.t)
        rate, least = LEARNING_RATE / (1 - 0.9**self.t) * root, 1e-6 * root
        for at in range(0, len(self.flat), 16_384):
            g, m, v, own, flat = (a[at:at + 16_384] for a in (self.grad, self.m, self.v, self.spare, self.flat))
            g *= scale
            m *= 0.9
            m += g
            g *= g  # a hundredth of the square
            v *= 0.99
            v += g
            np.sqrt(v, out=own)
            own += least
            np.divide(m, own, out=own)
            own *= rate
            flat -= own
            g.fill(0)


def train(p: dict, spans: list, d: Dictionary) -> int:
    """One pass over spans, a batch side by side; returns the tokens met."""
    import numpy as np

    adam, met = Adam(p), 0
    own, grads = adam.p, adam.grads
    for at in range(0, len(spans), BATCH):
        some = sorted(spans[at:at + BATCH], key=len, reverse=True)
        lengths = np.array([len(s) - 1 for s in some])
        ids = np.full((len(some), SPAN + 1), -1, np.int64)
        for row, s in zip(ids, some):
            row[:len(s)] = s
        h = np.zeros((len(some), HIDDEN), np.float32)
        for start in range(0, int(lengths[0]), WINDOW):
            live = int((lengths > start).sum())
            stop = min(start + WINDOW, int(lengths[0]))
            x, y = d.inp[ids[:live, start:stop].T], ids[:live, start + 1:stop + 1].T
            states, kept = forward(own, x, h[:live])
            flat, target = states.reshape(-1, HIDDEN), y.ravel()
            if lengths[live - 1] >= stop:
                _, back = outputs(own, flat, d.cls.take(target), d.slot.take(target), grads)
            else:
                valid = np.flatnonzero(np.arange(start, stop)[:, None] < lengths[None, :live])
                target, back = target.take(valid), np.zeros_like(flat)
                _, back[valid] = outputs(own, flat.take(valid, axis=0), d.cls.take(target), d.slot.take(target), grads)
            backward(own, x, kept, back.reshape(states.shape), grads)
            adam.step(max(1, len(target)))
            met += len(target)
            h = states[-1]
    for k, w in p.items():
        w[...] = own[k]
    return met


_LISTS = "array<int>"
_OUTSIDE = "array<struct<token:binary,times:bigint>>"


def _lists(values: list):
    """An Arrow column of arrays of numbers."""
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *values])))


def _arrays(column) -> list:
    """The arrays of an Arrow column of lists, without copying."""
    import numpy as np

    if not len(column):
        return []
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[ends[0]:ends[-1]], ends[1:-1] - ends[0])


def numbered(rows: DataFrame, d: Dictionary) -> DataFrame:
    """Every text as word numbers, the end included, with what its base score needs.

    ``mark`` is a hash of the row; ``outside`` counts the words without a number.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib
        from collections import Counter

        import numpy as np
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                marks, texts, base, n_out = [], [], [], []
                ends, outside, times = [0], [], []
                for i, body in zip(some.column(0).to_pylist(), some.column(1)):
                    body = body.as_py()
                    words = [*tokens(body), END]
                    ids = d.array(words)
                    missing = np.flatnonzero(ids < 0).tolist()
                    met = Counter(map(words.__getitem__, missing))
                    marks.append(zlib.crc32(body, zlib.crc32(str(i).encode())))
                    outside.extend(met)
                    times.extend(met.values())
                    ends.append(len(outside))
                    base.append(float(d.base.take(ids, mode="wrap").sum()))
                    n_out.append(len(missing))
                    texts.append(ids)
                pairs = pa.StructArray.from_arrays([pa.array(outside, pa.binary()), pa.array(times, pa.int64())], ["token", "times"])
                yield pa.record_batch([
                    some.column(0), some.column(2), pa.array(marks, pa.int64()), _lists(texts), pa.array(n_out, pa.int64()),
                    pa.array(base, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                    names=["doc_id", "held_out", "mark", "ids", "n_out", "base", "outside"])

    return rows.select("doc_id", "body", "held_out").mapInArrow(
        run, f"doc_id bigint, held_out boolean, mark bigint, ids {_LISTS}, n_out bigint, base double, outside {_OUTSIDE}")


def _cut(texts: DataFrame, d: Dictionary) -> DataFrame:
    import pyarrow as pa

    first = d.number.get(END, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        for batch in batches:
            keys, out = [], []
            for mark, ids in zip(batch.column(0).to_pylist(), _arrays(batch.column(1))):
                ids = np.concatenate([np.array([first], np.int32), ids])
                for k, at in enumerate(range(0, len(ids) - 1, SPAN)):
                    keys.append(zlib.crc32(f"span {mark} {k}".encode()) * (1 << 20) + k % (1 << 20))
                    out.append(ids[at:at + SPAN + 1])
            yield pa.record_batch([pa.array(keys, pa.int64()), _lists(out)], names=["key", "ids"])

    return texts.filter("not held_out").select("mark", "ids").mapInArrow(run, f"key bigint, ids {_LISTS}")


def spans(rows: DataFrame, d: Dictionary) -> DataFrame:
    """All spans of all training texts as word numbers, each with the token before it."""
    return _cut(numbered(rows, d), d)


def averaged(batches: Iterator) -> Iterator:
    """Mean of the weights of each part, by tokens trained on; holds one sum per part."""
    import numpy as np
    import pyarrow as pa

    sums: dict = {}
    for batch in batches:
        for part, met, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            own = np.asarray(weights.values, np.float64) * met
            old = sums.get(part)
            sums[part] = (own, met) if old is None else (old[0] + own, old[1] + met)
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([w / n for w, n in sums.values()], pa.list_(pa.float64()))],
                              names=["part", "weights"])


def fit(texts: DataFrame, d: Dictionary, rounds: int = ROUNDS) -> dict:
    """Train shards of numbered texts in parallel from common weights and average them, ``rounds`` times."""
    import numpy as np
    import pyarrow as pa

    p = initial(d)
    n_spans = F.sum(F.ceil(F.size("ids") / SPAN))
    shards = max(1, (texts.filter("not held_out").agg(n_spans).first()[0] or 0) // SHARD_SPANS)
    table = _cut(texts, d).repartition(shards, F.xxhash64("key")).sortWithinPartitions("key")
    names, block = sorted(p), 4096
    for _ in range(rounds):
        start = {k: w.copy() for k, w in p.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, met = {k: w.copy() for k, w in start.items()}, 0
            for batch in batches:
                met += train(own, _arrays(batch.column(0)), d)
            if met:
                flat = np.concatenate([own[k].ravel() for k in names])
                parts = [flat[i:i + block] for i in range(0, len(flat), block)]
                yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([met] * len(parts), pa.int64()),
                                       pa.array(parts, pa.list_(pa.float32()))], names=["part", "met", "weights"])

        # Every shard's weights meet by part; a task adds them up as they come.
        trained = table.select("ids").mapInArrow(run, "part int, met bigint, weights array<float>")
        parts = -(-sum(w.size for w in p.values()) // block)
        mean = trained.repartition(parts, "part").mapInArrow(averaged, "part int, weights array<double>").collect()
        if not mean:
            break
        flat = np.concatenate([np.array(r["weights"], np.float32) for r in sorted(mean, key=lambda r: r["part"])])
        at = 0
        for k in names:
            p[k] = flat[at:at + p[k].size].reshape(p[k].shape)
            at += p[k].size
    return p


def score_texts(p: dict, d: Dictionary, texts: list[list[int]]):
    """log10 probability of each text's tokens but for the part of outside words within their class."""
    import numpy as np

    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for at in range(0, len(order), SIDE_BY_SIDE):
        some = order[at:at + SIDE_BY_SIDE]
        lengths = np.array([len(texts[i]) for i in some])
        ids = np.concatenate([np.asarray(texts[i], np.int64) for i in some])
        begins = np.cumsum(lengths) - lengths
        logs = np.zeros(len(some))
        h = np.zeros((len(some), HIDDEN), np.float32)
        last = np.full(len(some), d.number.get(END, -1), np.int64)
        for start in range(0, int(lengths[0]), WINDOW):
            live = int((lengths > start).sum())
            steps = np.arange(start, min(start + WINDOW, int(lengths[0])))[:, None]
            valid = steps < lengths[None, :live]
            y = np.where(valid, ids[np.minimum(begins[:live] + steps, len(ids) - 1)], -1)
            x = np.concatenate([last[None, :live], y[:-1]])
            states = follow(p, d.inp[x], h[:live])
            at_once = np.flatnonzero(valid)
            target = y.ravel().take(at_once)
            logp, _ = outputs(p, states.reshape(-1, HIDDEN).take(at_once, axis=0), d.cls.take(target), d.slot.take(target))
            logs[:live] += np.bincount(at_once % live, logp / math.log(10) + d.within.take(target), live)
            h, last = states[-1], y[-1]
        out[some] = logs
    return out


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Every row with its token counts, unigram base score and the model's log10 probability."""
    import pyarrow as pa

    rows = _rows(docs)
    table = checkpoint(counts(rows))
    d = dictionary(table)
    texts = checkpoint(numbered(rows, d).withColumn("row", F.monotonically_increasing_id()))
    p = fit(texts, d, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _arrays(batch.column(5))
            yield pa.record_batch([*batch.columns[:5], pa.array([len(t) for t in found], pa.int64()), pa.array(score_texts(p, d, found), pa.float64())],
                                  names=["row", "doc_id", "held_out", "n_out", "base", "n_tokens", "logs"])

    scored = checkpoint(texts.select("row", "doc_id", "held_out", "n_out", "base", "ids").mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, n_out bigint, base double, n_tokens bigint, logs double"))
    rare = texts.select("row", F.inline("outside")).join(table, "token").groupBy("row").agg(
        F.sum("times").alias("met"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("gain"))
    met, gain = F.coalesce("met", F.lit(0)), F.coalesce("gain", F.lit(0.0))
    everything, rest = math.log10(d.total + d.distinct + 1), math.log10(d.rest_n + d.rest_v + 1)
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - F.col("n_out") + met).alias("n_known"),
        F.lit(d.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_out") * everything).alias("base_score"),
        (F.col("logs") + gain - F.col("n_out") * rest).alias("score"))


@query("op10_recurrent_lm")
def _recurrent(spark: SparkSession, folder: str) -> DataFrame:
    return score(documents(spark, folder))
