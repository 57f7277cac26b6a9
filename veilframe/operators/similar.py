"""Similarity joins on page words: an inverted index of characters, exact scores for survivors.

A text's elements are its characters, numbered by occurrence, so that two
texts have as many elements in common as characters, repeats counted. No
matching of blocks can match more, which turns a least score into a least number
of common elements. Texts that need so many in common must meet in the first
few of their elements by any fixed order (prefix filter); rare characters come
first. Only pairs that meet there, have fitting lengths and enough elements in
common are scored; none that reaches the score is lost.

Busy pages are joined on (keys, element), so that a page of any size is spread over
its characters. On a quiet one, with at most ``QUIET`` texts on the right, all texts meet
by the keys alone and the common characters are counted in place: an index has a row for
each character of each text, and each of them is dealt. Longer q-grams would cut more, but at the scores in use a short
word may differ in every pair of neighbours and still be alike.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import fuzzy
from veilframe.functions.scan import bind, dealt
from veilframe.session import checkpoint

#: Blank and letters by falling frequency in English; others count as rarer. Any order is right.
_FREQUENT = " etaoinshrdlcumwfgypbvkjxqz"


def elements(text: Column) -> Column:
    """Characters of a text with their occurrence number ('e', 'ee' ..), rare ones first."""
    ranked = F.translate(text, _FREQUENT, "".join(sorted(_FREQUENT, reverse=True)))
    runs = F.regexp_extract_all(F.array_join(F.array_sort(F.split(ranked, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda k: F.substring(r, F.lit(1), k))))


#: Texts of one key on the right up to which each on the left is compared with all of them.
QUIET = 256


def _apart(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Right texts of quiet keys that have texts on the left, dealt by the keys, and those of busy ones, if any."""
    asked = left.select(*keys).distinct()
    busy = checkpoint(right.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > QUIET).select(*keys))
    if busy.isEmpty():
        return right.join(dealt(asked), keys, "left_semi"), None
    quiet = right.join(dealt(busy), keys, "left_anti").join(dealt(asked), keys, "left_semi")
    return quiet, right.join(dealt(busy.join(dealt(asked), keys, "left_semi")), keys, "left_semi")


def _counts(text: Column) -> Column:
    """Distinct characters of a text with their numbers."""
    parts = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.transform(parts, lambda c: F.struct(c.alias("c"), _occurs(text, c).alias("k")))


def _occurs(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def _common(counts: str, text: Column) -> Column:
    """Number of characters that a text shares with the counted one, repeats counted."""
    return F.aggregate(counts, F.lit(0), lambda n, x: n + F.least(x["k"], _occurs(text, x["c"])))


def _in_place(left: DataFrame, right: DataFrame, keys: list[str], least_common: Column, fits: Column) -> DataFrame:
    """Pairs of equal keys, once each, that pass the length and count filters."""
    one = bind(left.select(*keys, "a").distinct(), a_k=_counts(F.col("a"))).withColumn("a_n", F.length("a"))
    two = right.select(*keys, "b").distinct().withColumn("b_n", F.length("b"))
    common = F.greatest(F.lit(1), least_common)
    return one.join(dealt(two), keys).where(fits).where(_common("a_k", F.col("b")) >= common).select(*keys, "a", "b")


def _sides(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> tuple[DataFrame, DataFrame]:
    return left.select(*keys, F.col(a).alias("a")), right.select(*keys, F.col(b).alias("b"))


def _least(least: int) -> float:
    return (least - 0.5) / 100  # scores are rounded


def _up(x: Column) -> Column:
    return F.ceil(x - 1e-9).cast("int")


def _index(df: DataFrame, keys: list[str], text: str, side: str, first) -> DataFrame:
    """Distinct texts with their elements and those by which they are looked up."""
    bound = bind(df.select(*keys, F.col(text).alias(side)).distinct(), **{f"{side}_all": elements(F.col(side))})
    n, size = F.length(side), F.size(f"{side}_all")
    return bound.withColumn(f"{side}_n", n).withColumn(f"{side}_first", first(F.col(f"{side}_all"), n, size))


def _met(left: DataFrame, right: DataFrame, keys: list[str], least_common: Column, fits: Column) -> DataFrame:
    """Pairs that meet in a looked-up element, once each, and pass the length and count filters."""
    a = left.select("*", F.explode("a_first").alias("_e"))
    b = right.select("*", F.explode("b_first").alias("_e"))
    pairs = a.join(dealt(b), [*keys, "_e"]).filter(fits)
    once = F.get(F.array_intersect("a_first", "b_first"), F.lit(0)) == F.col("_e")
    enough = F.size(F.array_intersect("a_all", "b_all")) >= least_common
    return pairs.filter(once).filter(enough).select(*keys, F.col("a"), F.col("b"))


def ratio_candidates(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: int) -> DataFrame:
    """Pairs (a, b) of equal keys, among them all with ``ratio(a, b) >= least``."""
    t = _least(least)

    def first(all_: Column, n: Column, size: Column) -> Column:
        need = _up((n + _up(n * t / (2 - t))) * t / 2)  # with the shortest fitting partner
        return F.slice(all_, F.lit(1), F.greatest(F.lit(0), size - need + 1))

    n, m = F.col("a_n"), F.col("b_n")
    enough, fits = (n + m) * (t / 2) - 1e-9, 2 * F.least(n, m) >= (n + m) * t - 1e-9
    left, right = _sides(left, right, keys, a, b)
    quiet, busy = _apart(left, right, keys)
    near = _in_place(left, quiet, keys, enough, fits)
    if busy is None:
        return near
    return near.unionByName(_met(_index(left, keys, "a", "a", first), _index(busy, keys, "b", "b", first), keys, enough, fits))


def partial_candidates(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: int) -> DataFrame:
    """Pairs (a, b) of equal keys, among them all with ``partial_ratio(a, b) >= least``.

    Only the shorter text bounds what must be shared, so its first elements are looked
    up among all of the longer one's.
    """
    t = _least(least)
    need = lambda n: _up(n * t / (2 - t))  # noqa: E731  a piece is at least as long as what it shares
    some = lambda all_, n, size: F.slice(all_, F.lit(1), F.greatest(F.lit(0), size - need(n) + 1))
    every = lambda all_, n, size: all_
    n, m = F.col("a_n"), F.col("b_n")
    left, right = _sides(left, right, keys, a, b)
    quiet, busy = _apart(left, right, keys)
    near = _in_place(left, quiet, keys, need(F.least(n, m)), F.lit(True))
    if busy is None:
        return near
    short_a = _met(_index(left, keys, "a", "a", some), _index(busy, keys, "b", "b", every), keys, need(n), n <= m)
    short_b = _met(_index(left, keys, "a", "a", every), _index(busy, keys, "b", "b", some), keys, need(m), n > m)
    return near.unionByName(short_a).unionByName(short_b)


def word_set(text: Column) -> Column:
    """Distinct words of letters and digits, sorted."""
    return F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", " ")), " +"), "")))


def token_set_candidates(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: int) -> DataFrame:
    """Pairs (a, b) of equal keys, among them all with ``token_set_ratio(a, b) >= least``: those
    that share a word, and those whose sorted words are alike."""
    left, right = _sides(left, right, keys, a, b)
    quiet, busy = _apart(left, right, keys)
    near = _words_in_place(left, quiet, keys, least)
    return near if busy is None else near.unionByName(_words_met(left, busy, keys, least))


def _words_in_place(left: DataFrame, right: DataFrame, keys: list[str], least: int) -> DataFrame:
    t = _least(least)
    one = bind(left.distinct(), a_set=word_set(F.col("a")))
    one = bind(one, a_norm=F.array_join("a_set", " "))
    one = bind(one, a_k=_counts(F.col("a_norm")), a_n=F.length("a_norm"))
    two = bind(right.distinct(), b_norm=F.array_join(word_set(F.col("b")), " ")).withColumn("b_n", F.length("b_norm"))
    n, m = F.col("a_n"), F.col("b_n")
    alike = (2 * F.least(n, m) >= (n + m) * t - 1e-9) & (_common("a_k", F.col("b_norm")) >= F.greatest(F.lit(1), (n + m) * (t / 2) - 1e-9))
    shares = F.arrays_overlap("a_set", F.split("b_norm", " "))
    return one.join(dealt(two), keys).where(shares | alike).select(*keys, "a", "b")


def _words_met(left: DataFrame, right: DataFrame, keys: list[str], least: int) -> DataFrame:
    a, b = "a", "b"
    split = lambda df, c, side: bind(df.select(*keys, F.col(c).alias(side)).distinct(), **{f"{side}_set": word_set(F.col(side))})
    one, two = split(left, a, "a"), split(right, b, "b")
    shared = one.select(*keys, "a", F.explode("a_set").alias("_w")).join(dealt(two.select(*keys, "b", F.explode("b_set").alias("_w"))), [*keys, "_w"])
    joined = lambda df, side: df.select(*keys, side, F.array_join(f"{side}_set", " ").alias(f"{side}_norm"))
    one, two = joined(one, "a"), joined(two, "b")
    alike = ratio_candidates(one, two, keys, "a_norm", "b_norm", least).withColumnsRenamed({"a": "a_norm", "b": "b_norm"})
    alike = alike.join(dealt(one), [*keys, "a_norm"]).join(dealt(two), [*keys, "b_norm"])
    return shared.select(*keys, "a", "b").unionByName(alike.select(*keys, "a", "b")).distinct()


def _kept(test) -> Column:
    @F.pandas_udf("boolean")
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([test(x, y) for x, y in zip(a, b)], dtype=bool)
    return column


def ratio_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: int) -> DataFrame:
    """Pairs (a, b) with ``ratio(a, b) >= least``, each once."""
    test = _kept(lambda x, y: fuzzy.reaches(x, y, least))
    return ratio_candidates(left, right, keys, a, b, least).filter(test("a", "b"))


def partial_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: int) -> DataFrame:
    """Pairs (a, b) with ``partial_ratio(a, b) >= least``, each once."""
    test = _kept(lambda x, y: fuzzy.partial_reaches(x, y, least))
    return partial_candidates(left, right, keys, a, b, least).filter(test("a", "b"))


def token_set_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, least: int) -> DataFrame:
    """Pairs (a, b) with their ``token_set_ratio`` of at least ``least``, each once."""
    scored = token_set_candidates(left, right, keys, a, b, least).withColumn("score", fuzzy.token_set_ratio_udf("a", "b"))
    return scored.filter(F.col("score") >= least)
