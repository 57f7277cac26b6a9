"""Bringing model predictions and text hits back to OCR tokens.

Pages are read as text segments of bounded length. A prediction meets the
segments of its page, never single tokens, so what travels is one row per
prediction and segment; the tokens under a hit are fetched by an equi-join on
their number.
"""
from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import fuzzy, geometry as G
from veilframe.functions import text as T
from veilframe.functions.scan import among, bind, dealt, unfold
from veilframe.operators import similar
from veilframe.operators.tokens import BOX, PAGE, PAGE_SIZE
from veilframe.session import checkpoint, written

SEGMENT_TOKENS = 512


def vote(preds: DataFrame) -> DataFrame:
    """Join equal predictions of several models; keep agreed or very sure ones."""
    score = F.col("score")
    exact = F.sum(score.cast("decimal(18,6)")).cast("double") / F.count("*")
    grouped = preds.groupBy(*PAGE, T.strip(F.col("word")).alias("word"), "entity_group").agg(
        F.count("*").alias("votes"), F.max(score).alias("top_score"), exact.alias("score"))
    return grouped.where((F.col("votes") >= C.NER_VOTES) | (F.col("top_score") > C.NER_SOLO_SCORE))


def accept(preds: DataFrame, shifts: DataFrame | None = None, variant: str = "v3") -> DataFrame:
    """Predictions that pass the word filters and their label's threshold.

    ``shifts`` has one row per label of a closed vocabulary and is broadcast.
    """
    word = T.strip(F.col("word"))
    named = preds.withColumn("word", word).withColumn("label", T.canonical_label(F.col("entity_group"), "v3"))
    word = F.col("word")
    named = named.where((F.length(word) > 2) & ~T.has_digit(word) & ~T.non_sensitive(word) & (F.col("label") != "O"))
    if variant == "v2":
        limit = F.when(F.col("label") == "B-PER", C.NER_THRESHOLDS_V2["B-PER"]).otherwise(C.NER_DEFAULT_THRESHOLD)
        return named.where(F.col("score") >= limit)
    base = F.lit(C.NER_DEFAULT_THRESHOLD)
    for label, value in C.NER_THRESHOLDS.items():
        base = F.when(F.col("label") == label, value).otherwise(base)
    if shifts is None:
        named = named.withColumn("shift", F.lit(0.0))
    else:
        named = named.join(F.broadcast(shifts), "label", "left").withColumn("shift", F.coalesce("shift", F.lit(0.0)))
    low, high = C.NER_THRESHOLD_RANGE
    limit = F.greatest(F.lit(low), F.least(F.lit(high), base + F.col("shift")))
    doubtful_place = (F.col("label") == "B-LOC") & (
        F.lower(word).isin(C.IGNORE_WORDS) | ((T.word_count(word) == 1) & (F.length(word) < 5)))
    return named.where((F.col("score") >= limit) & ~doubtful_place).drop("shift")


def _segments(tokens: DataFrame, ahead: int, size: int = SEGMENT_TOKENS) -> DataFrame:
    """Page segments with their tokens in order and the first ``ahead`` of the next."""
    seg = F.floor(F.col("idx") / size)
    places = F.when((F.col("idx") % size < ahead) & (seg > 0), F.array(seg, seg - 1)).otherwise(F.array(seg))
    token = F.struct("idx", "char0", F.lower(F.col("text")).alias("low"))
    placed = tokens.select(*PAGE, token.alias("t"), F.explode(places).alias("seg"))
    return placed.groupBy(*PAGE, "seg").agg(F.array_sort(F.collect_list("t")).alias("toks"))


def _needles(df: DataFrame, word: str = "word") -> DataFrame:
    low = F.lower(T.strip(F.col(word)))
    return df.select(*PAGE, low.alias("needle")).where(F.length("needle") > 0).distinct()


#: Characters of a needle's first word by which it is looked up.
GRAM = 3
#: Numbers that stand for the pieces a page's needles ask for.
ASKED = 1024


def _asked(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(ASKED)).cast("smallint")


def occurrences(needles: DataFrame, tokens: DataFrame) -> DataFrame:
    """First place of each needle in its page's lower-case text, found through an index of phrases.

    A needle starts somewhere in a token and, if it has several words, fills that
    token's rest. The first characters of its first word are an equi-join key; the
    tokens of a page are indexed under the pieces that start in them. What meets is
    compared in place, and following words are fetched by token number: first the
    second word, then, where that fits, the others. So the work is in proportion to
    tokens and hits, and a page of any size is spread over its pieces. Pieces that no
    needle of the page asks for are left out before anything is dealt by pieces.
    Tokens are numbered without gaps and hold no blanks.
    """
    low = tokens.select(*PAGE, "idx", "char0", F.lower(F.col("text")).alias("low"))
    parts = bind(needles.select(*PAGE, "needle"), parts=F.split("needle", " ", -1))
    head = F.get("parts", 0)
    keyed = parts.select("*", head.alias("head"), F.substring(head, F.lit(1), F.least(F.lit(GRAM), F.length(head))).alias("gram"))
    sizes = keyed.groupBy(*PAGE).agg(F.collect_set(F.length("gram")).alias("sizes"), F.collect_set(_asked(F.col("gram"))).alias("asked"))
    # The sizes of pieces that a page's needles ask for are GRAM at most, their numbers ASKED at most.
    pieces = F.filter(F.flatten(F.transform("sizes", lambda g: F.transform(
        F.when(F.length("low") >= g, F.sequence(F.lit(0), F.length("low") - g)).otherwise(F.array().cast("array<int>")),
        lambda at: F.struct(at.alias("inside"), F.substring(F.col("low"), at + 1, g).alias("gram"))))),
        lambda piece: F.array_contains("asked", _asked(piece["gram"])))
    index = unfold(low.join(dealt(sizes), PAGE), [*PAGE, "idx", "char0", "low"], pieces)
    more = F.size("parts") - 1
    rest = F.substring(F.col("low"), F.col("inside") + 1, F.length("low"))
    begins = F.when(more == 0, F.startswith(rest, F.col("head"))).otherwise(rest == F.col("head"))
    starts = index.join(dealt(keyed), [*PAGE, "gram"]).where(begins).select(*PAGE, "needle", "parts", "idx", "char0", "inside")
    # Read three times below, so it is written once.
    starts = written(starts, "starts")

    def following(hits: DataFrame, first: Column, last: Column) -> DataFrame:
        """Hits whose words from ``first`` to ``last`` are the tokens that follow."""
        names = [*PAGE, "needle", "idx", "char0", "inside"]
        steps = hits.select("*", F.explode(F.sequence(first, last)).alias("k")).withColumn("_at", F.col("idx") + F.col("k"))
        nxt = low.select(*PAGE, F.col("idx").alias("_at"), F.col("low").alias("_low"))
        word = F.get("parts", F.col("k"))
        fits = F.when(F.col("k") == more, F.startswith(F.col("_low"), word)).otherwise(F.col("_low") == word)
        met = steps.join(dealt(nxt), [*PAGE, "_at"]).where(fits)
        return met.groupBy(*names).agg(F.count("*").alias("_n"), F.first("parts").alias("parts"), F.first(last - first + 1).alias("_want")).where(
            "_n = _want").select(*PAGE, "needle", "parts", "idx", "char0", "inside")

    several = following(starts.where(more > 0), F.lit(1), F.lit(1))
    whole = starts.where(more == 0).unionByName(several.where(more == 1)).unionByName(following(several.where(more > 1), F.lit(2), more))
    at = F.struct((F.col("char0") + F.col("inside")).alias("place"), "idx", F.col("inside").cast("bigint").alias("inside"))
    return whole.groupBy(*PAGE, "needle").agg(F.min(at).alias("at")).select(*PAGE, "needle", "at.*")


def align(
    preds: DataFrame, tokens: DataFrame, rule: str = "v3", size: tuple = PAGE_SIZE, quiet_foot: bool = False,
) -> DataFrame:
    """Token runs under predictions, one box each.

    ``quiet_foot`` drops unsure predictions (score below .9) in the lowest
    quarter of a page, where machine-readable lines stand.

    Rule v3 wants the run to begin with the word and checks the box. Rule v0
    counts characters from the run's start twice, as its users expect, and may
    therefore end a run early.
    """
    found = occurrences(_needles(preds), tokens)
    parts = F.length("needle") - F.length(F.replace(F.col("needle"), F.lit(" "), F.lit("")))
    if rule == "v3":
        found = found.where("inside = 0")
    wide = found.select(*PAGE, "needle", "inside", F.col("idx").alias("first"), F.explode(F.sequence(F.lit(0), parts)).alias("k"))
    wide = wide.withColumn("idx", F.col("first") + F.col("k"))
    near = wide.join(dealt(tokens.select(*PAGE, "idx", "char0", "text", "left_x", "top", "width", "height")), PAGE + ["idx"])
    item = F.struct(
        "k", "char0", "text", F.col("left_x").alias("x0"), F.col("top").alias("y0"),
        (F.col("left_x") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))
    runs = near.groupBy(*PAGE, "needle", "first", "inside").agg(F.array_sort(F.collect_list(item)).alias("run"))
    start, need = F.get("run", 0)["char0"], F.length("needle")

    def enough(t: Column) -> Column:
        gone = t["char0"] - start
        if rule == "v3":
            return gone + F.length(t["text"]) >= need
        return gone * 2 + F.length(t["text"]) >= need + F.col("inside")

    ends = F.filter("run", enough)
    runs = runs.where(F.size(ends) > 0).withColumn("run", F.slice("run", F.lit(1), F.get(ends, 0)["k"] + 1))
    runs = runs.select(*PAGE, "needle", F.col("first").alias("idx"), F.size("run").alias("n_tokens"),
                       F.array_join(F.transform("run", lambda t: t["text"]), " ").alias("found"), G.union_box(F.col("run")).alias("_m"))
    if rule == "v3":
        box = G.valid_box(*[F.col(f"_m.{c}") for c in BOX], F.lit(size[0]), F.lit(size[1]))
        runs = runs.withColumn("_m", box).where("_m IS NOT NULL")
    keyed = preds.withColumn("needle", F.lower(T.strip(F.col("word")))).drop("word")
    joined = keyed.join(dealt(runs.select(*PAGE, "needle", "idx", "n_tokens", "found", "_m.*")), PAGE + ["needle"])
    if quiet_foot:
        joined = joined.where((F.col("y0") <= size[1] * 0.75) | (F.col("score") >= 0.90))
    return joined.withColumnRenamed("found", "word").drop("needle")


def _low(tokens: DataFrame) -> DataFrame:
    return tokens.select(*PAGE, "idx", F.lower(F.col("text")).alias("low"))


#: Needles of a page that travel together to its segments.
NEEDLE_BLOCK = 256


def _first_fit(needle: str, lows: list[str], own: int, widths: list[int], least: int) -> tuple[int, int] | None:
    """Start and width of the first run of tokens that holds something similar to the needle.

    Runs that have too few of its characters for the score are ruled out all at once,
    by running counts; the others are scored in order until one fits.
    """
    counts = Counter(needle)
    have = np.array([[low.count(c) for c in counts] for low in lows])
    sums = np.concatenate([np.zeros((1, len(counts)), int), have.cumsum(0)])
    size = np.concatenate([[0], np.array([len(low) for low in lows]).cumsum()])
    blank = np.array([c == " " for c in counts])
    first = np.arange(own)[:, None]
    last = np.minimum(first + np.array(widths), len(lows))
    gaps = last - first - 1
    held = sums[last] - sums[first] + gaps[..., None] * blank
    shared = np.minimum(held, np.array(list(counts.values()))).sum(-1)
    short = np.minimum(size[last] - size[first] + gaps, len(needle))
    for at, k in np.argwhere((shared > 0) & (2 * shared / np.maximum(1, short + shared) >= (least - 0.5) / 100)):
        if fuzzy.partial_reaches(needle, " ".join(lows[at:at + widths[k]]), least):
            return int(at), widths[k]
    return None


def _first_window(needles: DataFrame, tokens: DataFrame, widths: list[int], least: int) -> DataFrame:
    """Start (and width, the smallest that fits there) of the first run that holds something similar to a needle.

    Needles meet the segments of their page in blocks and are compared in place, so
    that no run is ever a row of its own and nothing behind the first fit is scored.
    """
    place = F.row_number().over(Window.partitionBy(*PAGE, F.pmod(F.xxhash64("needle"), F.lit(64))).orderBy("needle"))
    blocks = needles.select(*PAGE, "needle").distinct().withColumn("block", F.floor((place - 1) / (NEEDLE_BLOCK // 64)))
    blocks = blocks.groupBy(*PAGE, "block").agg(F.collect_list("needle").alias("needles"))
    segs = _segments(tokens, max(widths) - 1).select(
        *PAGE, F.transform("toks", lambda t: t["low"]).alias("lows"), F.get("toks", 0)["idx"].alias("idx0"),
        F.size(F.filter("toks", lambda t: F.floor(t["idx"] / SEGMENT_TOKENS) == F.col("seg"))).alias("own"))

    def run(batches):
        for batch in batches:
            found = []
            for doc, page, lows, idx0, own, wanted in zip(*[batch[c] for c in ("doc_id", "page_no", "lows", "idx0", "own", "needles")]):
                lows = list(lows)
                for needle in wanted:
                    fit = _first_fit(needle, lows, own, widths, least)
                    if fit:
                        found.append((doc, page, needle, idx0 + fit[0], fit[1]))
            yield pd.DataFrame(found, columns=["doc_id", "page_no", "needle", "idx", "w"])

    met = segs.where("own > 0").join(dealt(blocks), PAGE).select(*PAGE, "lows", "idx0", "own", "needles")
    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in PAGE)
    fits = met.mapInPandas(run, f"{kinds}, needle string, idx bigint, w int")
    return fits.groupBy(*PAGE, "needle").agg(F.min(F.struct("idx", "w")).alias("run")).select(*PAGE, "needle", "run.idx", "run.w")


def _boxed_run(found: DataFrame, tokens: DataFrame, keys: list[str], width: int | Column) -> DataFrame:
    """Fetch ``width`` tokens from ``idx`` on and put one box around them."""
    width = F.lit(width) if isinstance(width, int) else width
    wide = found.withColumn("k", F.explode(F.sequence(F.lit(0), width - 1))).withColumn("_at", F.col("idx") + F.col("k"))
    toks = tokens.select(*PAGE, F.col("idx").alias("_at"), "text", "left_x", "top", "width", "height")
    item = F.struct(
        "k", "text", F.col("left_x").alias("x0"), F.col("top").alias("y0"),
        (F.col("left_x") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))
    runs = wide.join(dealt(toks), PAGE + ["_at"]).groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(item)).alias("run"))
    return runs.select(*keys, "idx", F.size("run").alias("n_tokens"), F.array_join(F.transform("run", lambda t: t["text"]), " ").alias("word"),
                       G.union_box(F.col("run")).alias("_m")).select(*keys, "idx", "n_tokens", "word", "_m.*")


def align_fuzzy(preds: DataFrame, tokens: DataFrame, least: int = 72) -> DataFrame:
    """Tokens for predictions that do not occur literally: the most similar
    token, else the first run of four that holds something similar."""
    needles = _needles(preds)
    missing = checkpoint(needles.join(dealt(occurrences(needles, tokens).select(*PAGE, "needle")), PAGE + ["needle"], "left_anti"))
    words = _low(tokens)
    alike = similar.token_set_join(missing, words, PAGE, "needle", "low", least).withColumnsRenamed({"a": "needle", "b": "low"})
    best = F.max(F.struct("score", (-F.col("idx")).alias("neg"))).alias("m")
    single = checkpoint(alike.join(dealt(words), [*PAGE, "low"]).groupBy(*PAGE, "needle").agg(best).select(*PAGE, "needle", (-F.col("m.neg")).alias("idx")))
    rest = missing.join(dealt(single), PAGE + ["needle"], "left_anti")
    first = _first_window(rest, tokens, [4], 70)
    keys = [*PAGE, "needle"]
    places = single.select(*keys, "idx", F.lit(1).alias("w"), F.lit("token").alias("how")).unionByName(
        first.select(*keys, "idx", F.lit(4).alias("w"), F.lit("window").alias("how")))
    found = _boxed_run(places, tokens, [*keys, "how"], F.col("w"))
    found = found.select(*[c for c in found.columns if c != "how"], "how")
    labels = preds.select(*PAGE, F.lower(T.strip(F.col("word"))).alias("needle"), "entity_group", "score")
    return labels.join(dealt(found), keys)


def align_hits(hits: DataFrame, tokens: DataFrame, width: int = 6, variant: str = "v3") -> DataFrame:
    """Tokens for text hits (columns word, label): an equal token, else the
    first run that holds something similar.

    Runs have ``width`` tokens, in variant v1 one to eight: the first start
    that any run fits, and from there the shortest.
    """
    keyed = hits.select(*PAGE, F.lower(T.strip(F.col("word"))).alias("needle"), "label").where(F.length("needle") > 0).distinct()
    exact = checkpoint(exact_hits(hits, tokens))
    rest = keyed.join(dealt(exact), PAGE + ["needle", "label"], "left_anti").select(*PAGE, "needle").distinct()
    widths = list(range(1, 9)) if variant == "v1" else [width]
    first = _first_window(checkpoint(rest), tokens, widths, 70)
    keys = [*PAGE, "needle", "label"]
    one = _boxed_run(exact, tokens, keys, 1).withColumn("how", F.lit("token"))
    run = _boxed_run(first, tokens, [*PAGE, "needle"], F.col("w")).withColumn("how", F.lit("window"))
    labels = keyed.join(dealt(exact), keys, "left_anti")
    return one.unionByName(labels.join(dealt(run), [*PAGE, "needle"]).select(*one.columns))


def exact_hits(hits: DataFrame, tokens: DataFrame, tasks: int | None = None) -> DataFrame:
    """Only the first step of ``align_hits``: the first token equal to a hit.

    Both sides are sorted; ``tasks`` deals them among so many tasks.
    """
    keyed = hits.select(*PAGE, F.lower(T.strip(F.col("word"))).alias("needle"), "label").where(F.length("needle") > 0).distinct()
    low = tokens.select(*PAGE, "idx", F.lower(F.col("text")).alias("needle"))
    keyed, low = [among(side, tasks, *PAGE, "needle") for side in (keyed, low)]
    same = keyed.join(dealt(low), PAGE + ["needle"])
    return same.groupBy(*PAGE, "needle", "label").agg(F.min("idx").alias("idx"))


def propagate_names(people: DataFrame, tokens: DataFrame, lines: DataFrame) -> DataFrame:
    """More places of the people found on a page: like tokens and merged lines
    that hold a name. Boxes already known are left out."""
    people = written(people.select(*PAGE, "word", *BOX), "people")
    needles = people.select(*PAGE, F.lower(F.col("word")).alias("needle")).distinct()

    def spread(table: DataFrame, pairs) -> DataFrame:
        low = table.withColumn("low", F.lower(F.col("text")))
        like = pairs(low).select(*PAGE, F.col("b").alias("low")).distinct()
        return low.join(dealt(like), PAGE + ["low"], "left_semi").select(
            *PAGE, F.col("text").alias("word"), F.col("left_x").alias("x0"), F.col("top").alias("y0"),
            (F.col("left_x") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))

    args = (PAGE, "needle", "low")
    near = spread(tokens, lambda low: similar.ratio_join(needles, low, *args, 88).unionByName(similar.partial_join(needles, low, *args, 85))).unionByName(
        spread(lines, lambda low: similar.partial_join(needles, low, *args, 75)))
    fresh = near.join(dealt(people.select(*PAGE, *BOX).distinct()), PAGE + BOX, "left_anti")
    first = fresh.groupBy(*PAGE, *BOX).agg(F.min("word").alias("word"))
    return first.withColumn("label", F.lit("B-PER"))


def dictionary_entities(texts: DataFrame, keys: list[str], words: dict[str, str], text: str = "text") -> DataFrame:
    """A stand-in entity model: whole-word dictionary look-up with offsets."""
    patterns = [C.Pattern(label, r"\b(?:" + "|".join(rf"\Q{w}\E" for w, l in words.items() if l == label) + r")\b")
                for label in sorted(set(words.values()))]
    spans = unfold(texts, keys, T.find_spans(F.col(text), patterns), "s")
    return spans.select(*keys, "s.start", "s.end", F.col("s.original").alias("word"), F.col("s.label").alias("entity_group"))


def run_detectors(df: DataFrame, detectors: list, schema: str) -> DataFrame:
    """Run outside models over batches of rows; each is made once per worker task.

    ``detectors`` are factories; a detector maps a pandas batch to prediction
    rows. One that fails does not stop the others, but every row it missed comes
    out with the columns it shares with the predictions and the ``error``, so
    that nothing passes as free of findings.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def missed(batch: pd.DataFrame, number: int, error: str) -> pd.DataFrame:
        fixed = {"model": number, "error": error}
        plain = {c: pd.Series([fixed.get(c)] * len(batch), index=batch.index, dtype=object) for c in [*names, "error"]}
        return pd.DataFrame({**plain, **{c: batch[c] for c in batch.columns if c in names and c not in fixed}})

    def run(batches):
        live: list = []
        for number, make in enumerate(detectors):
            try:
                live.append((number, make(), None))
            except Exception as problem:  # reported with every row
                live.append((number, None, repr(problem)))
        for batch in batches:
            for number, detector, broken in live:
                if broken is None:
                    try:
                        rows = detector(batch)
                    except Exception as problem:  # reported with this batch's rows
                        yield missed(batch, number, repr(problem))
                        continue
                    if len(rows):
                        yield rows.assign(model=number, error=pd.Series([None] * len(rows), index=rows.index, dtype=object))
                else:
                    yield missed(batch, number, broken)

    return df.mapInPandas(run, f"{schema}, error string")
