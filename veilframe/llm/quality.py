"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are column expressions. Rules are conjunctions of
thresholds, grown and pruned on counts that Spark aggregates over labelled
documents, and come out as one ordered conditional expression, so applying
them is a map over the documents without a shuffle.

Defined results: a null text has no words and fails the base test; an empty
``labels`` table, or one without both classes, gives an empty list, which keeps
whatever passes the base test; null labels are not learned from; repeated rows
are judged alike; other columns of the input are neither read nor changed.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.scan import bind
from veilframe.llm.common import WORD, documents, let, words
from veilframe.llm.registry import query
from veilframe.session import checkpoint

WINDOW = 8
#: Most labelled documents a list is learned from: the first by hash of doc_id.
SAMPLE = 20_000
#: Thresholds tried for each statistic: this many quantiles.
QUANTILES = 24
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule is kept if, on the pruning third, this share of what it covers is bad.
PRECISION = 0.95
LEAST_COVER = 3

FEATURES = ["f_words", "f_word_len", "f_symbols", "f_dup_lines", "f_repeat", "f_upper", "f_marks", "f_distinct", "f_per_line"]


def repeat_words(ws: Column) -> Column:
    """Words inside 8-word windows that the text has twice or more.

    Windows are compared by 64-bit hash, built by doubling. Only texts in
    which some hash recurs sort their windows.
    """
    n = F.size(ws)

    def doubled(h: Column, by: int) -> Column:
        return let(h, lambda x: F.zip_with(x, F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0))), lambda a, b: F.xxhash64(a, b)))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    windows = let(doubled(doubled(doubled(hashes, 1), 2), 4), lambda h: F.slice(h, 1, F.size(h) - (WINDOW - 1)))

    def covered(h8: Column) -> Column:
        pairs = F.sort_array(F.transform(h8, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        again = let(pairs, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: same(s, k - 1, x) | same(s, k + 1, x)), lambda x: x["i"])))
        return let(again, lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x))

    return F.when(n < WINDOW, F.lit(0).cast("bigint")).otherwise(let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def statistics(text: Column) -> Column:
    """All statistics of a text as one struct."""
    text = F.coalesce(text, F.lit(""))
    count = lambda keep: F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("bigint")
    return let(words(text), lambda ws: F.struct(
        F.size(ws).cast("bigint").alias("n_words"),
        F.aggregate(ws, F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        repeat_words(ws).alias("n_repeat_words"),
        F.size(F.array_distinct(ws)).cast("bigint").alias("n_distinct"),
        count("A-Z").alias("n_upper"),
        count("!?").alias("n_marks"),
        F.size(F.split(text, "\n")).cast("bigint").alias("n_lines")))


def with_statistics(docs: DataFrame, text: str = "text", into: str = "_stats") -> DataFrame:
    """Add the statistics of each row's text as a struct, computed once."""
    return bind(docs, **{into: statistics(F.col(text))})


def base_failed(stats: str = "_stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])


def features(stats: str = "_stats") -> list[Column]:
    """What rules test: sizes and shares, in the order of ``FEATURES``."""
    s = F.col(stats)
    one = lambda x: F.greatest(x, F.lit(1)).cast("double")
    shares = [s["n_words"].cast("double"), s["word_chars"] / one(s["n_words"]), s["n_symbols"] / one(s["word_chars"]),
              s["n_dup_lines"] / one(s["n_lines"]), s["n_repeat_words"] / one(s["n_words"]), s["n_upper"] / one(s["word_chars"]),
              s["n_marks"] / one(s["n_words"]), s["n_distinct"] / one(s["n_words"]), s["n_words"] / one(s["n_lines"])]
    return [c.alias(n) for c, n in zip(shares, FEATURES)]


@dataclass(frozen=True)
class Condition:
    """``feature >= cut`` if ``above``, else ``feature < cut``; ``bin`` is the cut's number."""
    feature: int
    above: bool
    bin: int
    cut: float

    def on_bins(self) -> Column:
        b = F.get(F.col("bins"), F.lit(self.feature))
        return b >= self.bin if self.above else b < self.bin

    def on(self, columns: list[Column]) -> Column:
        return columns[self.feature] >= self.cut if self.above else columns[self.feature] < self.cut

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.cut:.6g}"


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics and label of at most ``sample`` labelled documents.

    The sample is bounded, so the labels are broadcast and only the
    documents in it are measured.
    """
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("bad"))
    chosen = chosen.groupBy("_id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    measured = with_statistics(met).filter(~base_failed())
    return measured.select("bad", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) > 0).alias("grow"), *features())


def _bin(value: Column, edges: list[float]) -> Column:
    """How many of the cuts are at or below the value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value))


def _counts(table: DataFrame, tests: list[Condition]) -> dict[tuple[int, int, bool], int]:
    """Rows that pass the tests, by statistic, bin and label."""
    seen = table.filter(_all([t.on_bins() for t in tests])).select("bad", "n", F.posexplode("bins").alias("f", "b"))
    return {(r["f"], r["b"], r["bad"]): r["n"] for r in seen.groupBy("f", "b", "bad").agg(F.sum("n").alias("n")).collect()}


def _best(counts: dict, cuts: list[list[float]], weigh) -> tuple[float, Condition, int, int] | None:
    best = None
    for f, edges in enumerate(cuts):
        total = {bad: sum(counts.get((f, b, bad), 0) for b in range(len(edges) + 1)) for bad in (True, False)}
        under = {True: 0, False: 0}
        for b in range(1, len(edges) + 1):
            for bad in under:
                under[bad] += counts.get((f, b - 1, bad), 0)
            for above in (True, False):
                p, n = [total[x] - under[x] if above else under[x] for x in (True, False)]
                if p and (gain := weigh(p, n)) > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, Condition(f, above, b, edges[b - 1]), p, n)
    return best


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """The ordered list of rules; a document that meets one is rejected.

    Sequential covering: a rule grows by the condition with most information
    gain on two thirds of the sample, loses trailing conditions as long as the
    other third gains by it, and takes what it covers out of both. Learning ends
    when no rule reaches ``PRECISION`` on the other third. Only counts by
    statistic, bin and label reach the driver.
    """
    import math

    table = checkpoint(labelled(docs, labels, sample))
    steps = [i / (QUANTILES + 1) for i in range(1, QUANTILES + 1)]
    # Cuts come from both classes, so a rare class has cuts of its own.
    found = table.groupBy("bad").agg(*[F.percentile_approx(c, steps, 10_000).alias(c) for c in FEATURES]).collect()
    if len(found) < 2:
        return []
    cuts = [sorted({v for r in found for v in r[c]}) for c in FEATURES]
    bins = F.array(*[_bin(F.col(c), edges) for c, edges in zip(FEATURES, cuts)])
    rest = checkpoint(table.select("bad", "grow", bins.alias("bins")).groupBy("bad", "grow", "bins").agg(F.count("*").alias("n")))
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        rule: list[Condition] = []
        growing = rest.filter("grow")
        counts = _counts(growing, rule)
        p = sum(v for (f, _, bad), v in counts.items() if f == 0 and bad)
        n = sum(v for (f, _, bad), v in counts.items() if f == 0 and not bad)
        while p and n and len(rule) < MAX_CONDITIONS:
            was = math.log2(p / (p + n))
            best = _best(counts, cuts, lambda a, b: a * (math.log2(a / (a + b)) - was))
            if best is None:
                break
            rule.append(best[1])
            p, n = best[2], best[3]
            if n:
                counts = _counts(growing, rule)
        if not rule:
            break
        # Every prefix of the rule, judged on the other third.
        tallies = rest.filter(~F.col("grow")).agg(*[
            F.coalesce(F.sum(F.when(_all([t.on_bins() for t in rule[:k]]) & (F.col("bad") == bad), F.col("n"))), F.lit(0)).alias(f"{'p' if bad else 'n'}{k}")
            for k in range(1, len(rule) + 1) for bad in (True, False)]).first()
        worth = {k: (tallies[f"p{k}"] - tallies[f"n{k}"]) / max(tallies[f"p{k}"] + tallies[f"n{k}"], 1) for k in range(1, len(rule) + 1)}
        size = max(worth, key=lambda k: (worth[k], -k))
        good, wrong = tallies[f"p{size}"], tallies[f"n{size}"]
        if good < LEAST_COVER or good < PRECISION * (good + wrong):
            break
        rules.append(rule[:size])
        rest = rest.filter(~_all([t.on_bins() for t in rule[:size]]))
    return rules


def verdict(rules: list[list[Condition]], stats: str = "_stats") -> Column:
    """The list as one ordered conditional expression: true to keep."""
    columns = features(stats)
    out = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        out = out.when(_all([t.on(columns) for t in rule]), F.lit(False))
    return out.otherwise(F.lit(True))


def fired(rules: list[list[Condition]], stats: str = "_stats") -> Column:
    """Number of the first rule that a document meets, from 1; null if none."""
    columns, out = features(stats), F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(rules):
        out = out.when(_all([t.on(columns) for t in rule]), F.lit(i + 1))
    return out


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Statistics and verdict of every row, learned rules applied."""
    rules = learn(docs, labels, sample)
    s = F.col("_stats")
    return with_statistics(docs.select("doc_id", "text")).select(
        "doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed().alias("base_failed"), verdict(rules).alias("kept"), fired(rules).alias("rule"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows that the learned list keeps, with their own columns."""
    rules = learn(docs, labels, sample)
    return with_statistics(docs, into="_veilframe_stats").filter(verdict(rules, "_veilframe_stats")).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op3_quality_rules")
def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
