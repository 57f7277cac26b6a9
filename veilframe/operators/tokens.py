"""Detectors over OCR tokens.

Tokens are numbered once per page (``idx``). Whatever looks at neighbours then
joins on (document, page, idx) or works in bounded segments of a page, so a
page that holds a large share of all tokens still spreads over many tasks.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import geometry as G
from veilframe.functions import text as T
from veilframe.functions.scan import SEGMENT, bands, bind, dealt, exclusive_scan, ordered_fold, unfold

PAGE = ["doc_id", "page_no"]
PAGE_SIZE = (2550, 3300)
BOX = ["x0", "y0", "x1", "y1"]
DETECTION = [*PAGE, "idx", "n_tokens", "word", *BOX, "label", "pattern", "priority"]


def number_tokens(tokens: DataFrame, gap: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Add ``idx``, the place of a token on its page, counted without holes.

    ``char0`` is the token's place in the page text. ``gap`` is an optional
    condition; ``gaps`` then counts earlier tokens that meet it, which names
    the runs between them.
    """
    measures = {"idx": ("sum", F.lit(1).cast("bigint")), "char0": ("sum", (F.length("text") + 1).cast("bigint"))}
    if gap is not None:
        measures["gaps"] = ("sum", F.when(gap, 1).otherwise(0).cast("bigint"))
    return exclusive_scan(tokens, PAGE, F.floor(F.col("pos") / SEGMENT), ["pos"], measures, tasks)


def token_box(size: tuple = PAGE_SIZE) -> Column:
    """The validated box of a token."""
    left, top = F.col("left_x"), F.col("top")
    return G.valid_box(left, top, left + F.col("width"), top + F.col("height"), F.lit(size[0]), F.lit(size[1]))


def _spread(tokens: DataFrame, size: int, ahead: int) -> DataFrame:
    """Put tokens into page segments; the first few of a segment also end the one before."""
    seg = F.floor(F.col("idx") / size)
    own = F.struct(seg.alias("seg"), F.lit(True).alias("own"))
    also = F.struct((seg - 1).alias("seg"), F.lit(False).alias("own"))
    places = F.when((F.col("idx") % size < ahead) & (seg > 0), F.array(own, also)).otherwise(F.array(own))
    return tokens.select("*", F.inline(places))


def _detections(df: DataFrame, box: Column) -> DataFrame:
    return bind(df, _box=box).where("_box IS NOT NULL").select("*", "_box.*").drop("_box")


def match_tokens(tokens: DataFrame, patterns: list[C.Pattern], size: tuple = PAGE_SIZE) -> DataFrame:
    """Single tokens that a catalogue pattern covers entirely."""
    word = T.strip(F.col("text"))
    hits = tokens.where(T.any_of(word, patterns, full=True))
    rows = F.array_compact(F.array(*[F.when(word.rlike(T.full_regex(p)), _row(p, i)) for i, p in enumerate(patterns)]))
    keep = [*PAGE, "idx", F.lit(1).alias("n_tokens"), word.alias("word"), token_box(size).alias("_b")]
    named = unfold(hits, keep, rows)
    return named.where("_b IS NOT NULL").select(*PAGE, "idx", "n_tokens", "word", "_b.*", "label", "pattern", "priority", "pno")


def _row(p: C.Pattern, i: int) -> Column:
    return F.struct(F.lit(p.label).alias("label"), F.lit(p.name).alias("pattern"),
                    F.lit(p.priority).alias("priority"), F.lit(i).alias("pno"))


def match_windows(
    tokens: DataFrame, patterns: list[C.Pattern], longest: int = 10, size: tuple = PAGE_SIZE, segment: int = SEGMENT,
) -> DataFrame:
    """Runs of 2 to ``longest`` tokens that, joined by nothing, a blank or a
    dash, a pattern covers entirely; the first joiner that fits counts."""
    if segment < longest - 1:
        raise ValueError("a segment must hold the tokens borrowed from the next one")
    clean = F.regexp_replace(T.strip(F.col("text")), r"(?U)\s+", " ")
    placed = _spread(tokens.select(*PAGE, "idx", clean.alias("t"), token_box(size).alias("b")), segment, longest - 1)
    inside = Window.partitionBy(*PAGE, "seg").orderBy("idx")
    ahead = inside.rowsBetween(0, longest - 1)
    needed = "".join(sorted({p.needs for p in patterns if p.needs}))
    most = max((p.longest for p in patterns), default=0)
    heads = "".join(p.first for p in patterns if not p.longest and not p.needs)
    tails = "".join(p.last for p in patterns if not p.longest and not p.needs)
    # What a token alone decides is found once per token, not once per run that holds it.
    short = [p for p in patterns if p.longest and not p.needs]
    digits = bool(short) and all(T.needs(p)[0] for p in short)
    tests = {"marked": rf"[{needed}]" if needed else "", "digit": r"(?U)\d" if digits else "", "opens": rf"(?U)\A[{heads}]" if heads else "", "closes": rf"[{tails}]\z" if tails else ""}
    placed = placed.select("*", *[(F.col("t").rlike(test) if test else F.lit(False)).alias(name) for name, test in tests.items()])
    placed = placed.withColumn("c", F.sum(F.length("t")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # An absent box would vanish from a collected list, so it travels in a struct.
    runs = placed.select(*PAGE, "idx", "own", "opens", F.col("c") - F.length("t"), F.collect_list(F.struct("t", "b", "c", "closes")).over(ahead).alias("run"),
                         *[F.min(F.when(F.col(flag), F.col("idx"))).over(ahead) - F.col("idx") for flag in ("marked", "digit")])
    runs = runs.toDF(*PAGE, "idx", "own", "opens", "c0", "run", "mark", "digit").where("own AND size(run) > 1")

    # Most runs are ruled out by length, a missing character or their first
    # letter before any text is put together.
    def hopeful(n: Column) -> Column:
        end = F.get("run", n - 1)
        brief = end["c"] - F.col("c0") <= most
        return (brief & (n > F.col("digit")) if digits else brief) | (n > F.col("mark")) | (F.col("opens") & end["closes"])

    sizes = F.filter(F.sequence(F.lit(2), F.size("run")), hopeful)
    tried = unfold(runs, [*PAGE, "idx", "opens", "run"], sizes, "n_tokens")
    # Runs become rows here, so that texts are put together and tested by compiled expressions.
    words = {f"w{i}": F.concat_ws(sep, F.slice("run.t", F.lit(1), F.col("n_tokens"))) for i, sep in enumerate(("", " ", "-"))}

    # One test per kind of pattern, so that only hits are told apart.
    kinds = [[p for p in patterns if p.needs], [p for p in patterns if p.longest and not p.needs],
             [p for p in patterns if not p.longest and not p.needs]]

    def any_fit(word: Column) -> Column:
        limits = [reduce(or_, [F.contains(word, F.lit(c)) for c in needed], F.lit(False)), F.length(word) <= most,
                  F.col("opens") & F.get("run", F.col("n_tokens") - 1)["closes"]]
        tests = [limit & T.any_of(word, kind, True) for limit, kind in zip(limits, kinds) if kind]
        return reduce(or_, tests)

    fitting = bind(tried, **words).where(any_fit(F.col("w0")) | any_fit(F.col("w1")) | any_fit(F.col("w2")))
    texts = fitting.select(*PAGE, "idx", "n_tokens", *[F.when(any_fit(F.col(w)), F.col(w)).alias(w) for w in words], F.array_compact(F.slice("run.b", F.lit(1), F.col("n_tokens"))).alias("boxes"))

    def fits(p: C.Pattern, word: Column) -> Column:
        """The pattern covers the word; cheap necessary conditions come first."""
        test = word.rlike(T.full_regex(p))
        if p.needs:
            test = word.contains(p.needs) & test
        return (F.length(word) <= p.longest) & test if p.longest else test

    def hit(p: C.Pattern, i: int) -> Column:
        chosen = F.when(fits(p, F.col("w0")), 0).when(fits(p, F.col("w1")), 1).when(fits(p, F.col("w2")), 2)
        return F.struct(chosen.alias("joiner"), *[_row(p, i)[n].alias(n) for n in ("label", "pattern", "priority", "pno")])

    rows = F.filter(F.array(*[hit(p, i) for i, p in enumerate(patterns)]), lambda h: h["joiner"].isNotNull())
    found = unfold(texts, [*PAGE, "idx", "n_tokens", "boxes", *words], rows)
    found = found.withColumn("word", F.element_at(F.array(*words), F.col("joiner") + 1))
    merged = bind(found, _m=G.union_box(F.col("boxes")))
    box = G.valid_box(*[F.col(f"_m.{c}") for c in BOX], F.lit(size[0]), F.lit(size[1]))
    return _detections(merged, box).select(*PAGE, "idx", "n_tokens", "word", *BOX, "label", "pattern", "priority", "pno")


def find_patterns(tokens: DataFrame, patterns: list[C.Pattern], size: tuple = PAGE_SIZE) -> DataFrame:
    """Token and window matches of a catalogue together."""
    return match_tokens(tokens, patterns, size).unionByName(match_windows(tokens, patterns, size=size))


def machine_readable(tokens: DataFrame, size: tuple = PAGE_SIZE) -> DataFrame:
    """Machine-readable zone lines: strict passport lines and plain ones."""
    word = T.strip(F.col("text"))
    whole = word.rlike(T.full_regex(C.MRZ_REGEX))
    strict = whole & (F.length(word) > C.MRZ_MIN_LENGTH) & T.is_upper(word) & word.contains("<")
    names = F.array_compact(F.array(F.when(strict, F.lit("PASSPORT_MRZ")), F.lit("MRZ")))
    points = F.create_map(*[F.lit(x) for kv in C.MRZ_PRIORITY.items() for x in kv])
    rows = tokens.where(whole).select(
        *PAGE, "idx", F.lit(1).alias("n_tokens"), word.alias("word"), token_box(size).alias("_b"),
        F.lit("B-DOC").alias("label"), F.explode(names).alias("pattern"))
    return rows.where("_b IS NOT NULL").select(*rows.columns, "_b.*", points[F.col("pattern")].alias("priority")).select(*DETECTION)


def field_values(tokens: DataFrame, size: tuple = PAGE_SIZE, limit: int = C.FIELD_VALUES) -> DataFrame:
    """Values beside form labels: up to ten tokens back and fourteen ahead on the line."""
    word = T.strip(F.col("text"))
    rows = F.array_compact(F.array(*[
        F.when(word.rlike(T.regex(p)), _row(p, i)) for i, p in enumerate(C.FIELD_LABELS)]))
    labels = unfold(tokens.where((F.length(word) >= 3) & T.any_of(word, C.FIELD_LABELS)), [
        *PAGE, F.col("idx").alias("at"), F.col("top").alias("line"),
        F.greatest(F.lit(15.0), F.col("height") * 0.7).alias("reach")], rows)
    steps = [s for s in range(-C.FIELD_LOOK_BACK, C.FIELD_LOOK_AHEAD + 1) if s]
    wanted = labels.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).withColumn("idx", F.col("at") + F.col("step"))
    near = wanted.join(dealt(tokens.select(*PAGE, "idx", "text", "left_x", "top", "width", "height")), PAGE + ["idx"])
    word = T.strip(F.col("text"))
    item = F.struct(
        "step", "text", F.col("left_x").alias("x0"), F.col("top").alias("y0"),
        (F.col("left_x") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"),
        (word.isin(C.FIELD_SEPARATORS) | (word == "")).alias("sep"),
        T.any_of(word, C.FIELD_LABELS).alias("stop"),
        (F.abs(F.col("top") - F.col("line")) <= F.col("reach")).alias("level"),
        T.non_sensitive(word).alias("plain"),
        (T.is_alpha(word) & T.starts_upper(word) & (F.length(word) >= 3)).alias("named"))
    key = [*PAGE, "at", "label", "pattern", "priority", "pno"]
    around = near.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("near"))
    back = F.reverse(F.filter("near", lambda t: (t["step"] < 0) & ~t["sep"] & t["level"] & t["named"] & ~t["plain"]))
    around = bind(around, back=back)
    start = F.struct(F.lit(True).alias("open"), F.slice("back", F.lit(1), F.lit(0)).alias("kept"))

    def step(state: Column, t: Column) -> Column:
        kept = F.when(t["plain"], state["kept"]).otherwise(F.concat(state["kept"], F.array(t)))
        return (
            F.when(~state["open"] | t["sep"], state)
            .when(t["stop"] | ~t["level"], F.struct(F.lit(False).alias("open"), state["kept"].alias("kept")))
            .otherwise(F.struct((F.size("back") + F.size(kept) < limit).alias("open"), kept.alias("kept"))))

    ahead = F.aggregate(F.filter("near", lambda t: t["step"] > 0), start, step, lambda s: s["kept"])
    valued = bind(around, values=F.concat("back", ahead)).where("size(values) > 0")
    valued = bind(valued, word=F.array_join(F.transform("values", lambda t: t["text"]), " "), _m=G.union_box(F.col("values")))
    box = G.valid_box(*[F.col(f"_m.{c}") for c in BOX], F.lit(size[0]), F.lit(size[1]))
    found = valued.where(F.length(T.strip(F.col("word"))) >= 3).withColumn("idx", F.col("at")).withColumn("n_tokens", F.size("values"))
    return _detections(found, box).select(*DETECTION)


def name_context(tokens: DataFrame, size: tuple = PAGE_SIZE, cell: int = 64) -> DataFrame:
    """Capitalised words on the line of a name label, right of it or well left.

    Labels reach over a few height cells; tokens meet them cell by cell, and a
    semi join gives each token once however many labels it stands beside.
    """
    low = F.lower(T.strip(F.col("text")))
    reach = F.greatest(F.lit(15.0), F.col("height") * 0.7)
    labels = tokens.where(low.isin(C.NAME_LABEL_WORDS)).select(
        *PAGE, F.col("top").alias("l_top"), reach.alias("reach"), F.col("left_x").alias("l_left"),
        (F.col("left_x") + F.col("width")).alias("l_right")).distinct()
    labels = labels.withColumn("cell", F.explode(F.sequence(
        F.floor((F.col("l_top") - F.col("reach")) / cell), F.floor((F.col("l_top") + F.col("reach")) / cell))))
    word = T.strip(F.col("text"))
    names = tokens.where(
        (F.length(word) >= 3) & T.starts_upper(word) & T.mostly_letters(word) & ~T.non_sensitive(word)
        & ~low.isin(C.NAME_LABEL_EXCLUDED)).withColumn("cell", F.floor(F.col("top") / cell))
    beside = (F.abs(names["top"] - F.col("l_top")) <= F.col("reach")) & (
        (names["left_x"] > F.col("l_right")) | (names["left_x"] < F.col("l_left") - 100))
    same = [names[k] == labels[k] for k in PAGE + ["cell"]]
    on = same[0] & same[1] & same[2] & beside
    found = names.join(dealt(labels), on, "left_semi")
    found = found.select(*PAGE, "idx", F.lit(1).alias("n_tokens"), F.col("text").alias("word"), token_box(size).alias("_b"),
                         F.lit("B-PER").alias("label"), F.lit("NAME_FIELD_CONTEXT").alias("pattern"), F.lit(92).alias("priority"))
    return found.where("_b IS NOT NULL").select("*", "_b.*").select(*DETECTION)


def upper_names(tokens: DataFrame, size: tuple = PAGE_SIZE, variant: str = "v3") -> DataFrame:
    """Runs of upper-case (v3) or capitalised (v2) words taken for names.

    Tokens that cannot belong to a name split a page into independent runs.
    A name starts at the first fitting token and takes the words after it; the
    scan goes on behind the name, or one token on if the run was too long. Tokens
    that are numbered already (``idx``) are not numbered again.
    """
    word = T.strip(F.col("text"))
    if variant == "v3":
        joins = T.is_upper(word) & T.is_alpha(word) & ~word.isin(C.NAME_STOPWORDS)
        begins = (F.length(word) >= 3) & ~T.has_digit(word) & (F.col("top") <= size[1] * 0.75)
        reach, most, least, look = F.lit(14.999), 4, 2, 5
    else:
        joins = ((F.length(word) >= 2) & T.starts_upper(word) & T.mostly_letters(word) & ~T.non_sensitive(word)
                 & ~F.lower(word).isin(C.IGNORE_WORDS))
        begins = F.length(word) >= 3
        reach, most, least, look = F.greatest(F.lit(15.0), F.col("height") * 0.7), 6, 1, 6
    if "idx" in tokens.columns:
        # Numbered before: only tokens that end no run are counted, the rest of a place is those that do.
        inside = tokens.where(F.coalesce(joins, F.lit(True)))
        numbered = exclusive_scan(inside, PAGE, F.floor(F.col("idx") / SEGMENT), ["idx"], {"_inside": ("sum", F.lit(1).cast("bigint"))})
        numbered = numbered.withColumn("gaps", F.col("idx") - F.col("_inside"))
    else:
        numbered = number_tokens(tokens, ~joins)
    runs = numbered.where(joins).select(
        *PAGE, "gaps", "idx", F.col("text").alias("word"), F.col("left_x").alias("x0"), F.col("top").alias("y0"),
        (F.col("left_x") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"),
        begins.alias("begins"), reach.cast("double").alias("reach"))

    def take(buffer: list) -> tuple[list, list]:
        """Settle the first token of the buffer: a name, or one token skipped."""
        head = buffer[0]
        n = 1
        while head.begins and n < min(look, len(buffer)) and abs(buffer[n].y0 - head.y0) <= head.reach:
            n += 1
        if not head.begins or not least <= n <= most:
            return buffer[1:], []
        used = buffer[:n]
        name = " ".join(t.word for t in used)
        box = (min(t.x0 for t in used), min(t.y0 for t in used), max(t.x1 for t in used), max(t.y1 for t in used))
        return buffer[n:], [(head.doc_id, head.page_no, head.idx, n, name, *box)]

    def step(buffer: list, row: tuple) -> tuple[list, list]:
        buffer = [*buffer, row]
        return take(buffer) if len(buffer) == look else (buffer, [])

    def finish(buffer: list) -> list:
        out: list = []
        while buffer:
            buffer, done = take(buffer)
            out += done
        return out

    schema = "doc_id bigint, page_no int, idx bigint, n_tokens int, word string, x0 int, y0 int, x1 int, y1 int"
    named = ordered_fold(runs, [*PAGE, "gaps"], [F.col("idx")], list, step, finish, schema)
    if variant == "v3":
        named = named.where(F.length("word") <= 40).withColumn("priority", F.lit(80))
    else:
        named = named.where(~T.non_sensitive(F.col("word")) & (F.length("word") >= 4))
        named = named.withColumn("priority", F.when(F.col("n_tokens") >= 2, 85).otherwise(82))
    box = G.valid_box(*[F.col(c) for c in BOX], F.lit(size[0]), F.lit(size[1]))
    fixed = named.withColumn("_b", box).where("_b IS NOT NULL").drop(*BOX).select("*", "_b.*")
    return fixed.withColumn("label", F.lit("B-PER")).withColumn("pattern", F.lit("CAPITALIZED_NAME")).select(*DETECTION)


def merge_lines(tokens: DataFrame, variant: str = "v0") -> DataFrame:
    """Join tokens that follow each other closely on a line.

    Reading order is top, left. A token can only extend a line that reaches
    its height, so pages split into bands of nearby tops first.
    """
    slack = F.greatest(F.lit(8), F.floor(F.col("height") * 0.02)).cast("int")
    banded = bands(tokens, PAGE, "top", F.col("top"), "band", slack)
    rows = banded.select(*PAGE, "band", "pos", "text", "left_x", "top", "width", "height", slack.alias("slack"))

    def closes(cur: list, row: tuple) -> bool:
        gap = row.left_x - (cur[2] + cur[4])
        if abs(row.top - cur[3]) > row.slack:
            return True
        if variant == "v0":
            return gap > max(20, int(0.2 * row.width))
        return not (0 <= gap <= max(15, int(0.15 * row.width)) and len(cur[1].split()) < 5)

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list]:
        fresh = (row.doc_id, row.page_no, [row.pos, row.text, row.left_x, row.top, row.width, row.height, 1])
        if state is None:
            return fresh, []
        cur = state[2]
        if closes(cur, row):
            return fresh, [(*state[:2], *cur)]
        cur = [cur[0], f"{cur[1]} {row.text}", cur[2], cur[3], row.left_x + row.width - cur[2], cur[5], cur[6] + 1]
        return (*state[:2], cur), []

    schema = ("doc_id bigint, page_no int, pos bigint, text string, left_x int, top int, width int, height int, n_tokens int")
    return ordered_fold(rows, [*PAGE, "band"], [F.col("top"), F.col("left_x"), F.col("pos")], lambda: None, step,
                        lambda s: [(*s[:2], *s[2])] if s else [], schema)


def page_text(tokens: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Token texts of a page joined by blanks, built piecewise."""
    def joined(order: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda t: t["text"]), " ")

    parts = tokens.groupBy(*PAGE, F.floor(F.col("pos") / segment).alias("seg")).agg(joined("pos").alias("text"))
    return parts.groupBy(*PAGE).agg(joined("seg").alias("text"))


def rescue_ids(
    tokens: DataFrame, found: DataFrame, patterns: list[C.Pattern], lengths: list[int],
) -> DataFrame:
    """Identifiers that no detection covers yet, at their first token.

    An identifier counts as covered if some detected word of the page holds
    it, blanks aside. Detected words are cut into pieces of the identifiers'
    lengths, so the test is an equi-join and not a comparison of all pairs.
    """
    bare = F.replace(F.col("text"), F.lit(" "), F.lit(""))
    whole = T.any_of(T.strip(F.col("text")), patterns, full=True)
    hits = tokens.where(whole).withColumn("hit", bare).groupBy(*PAGE, "hit").agg(
        F.min_by(F.struct("idx", "left_x", "top", "width", "height"), "idx").alias("t"))
    word = F.replace(F.col("word"), F.lit(" "), F.lit(""))
    pieces = found.select(*PAGE, word.alias("w")).distinct()
    cut = F.flatten(F.array(*[
        F.when(F.length("w") >= n, F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i, n=n: F.substring("w", i, F.lit(n))))
        .otherwise(F.array().cast("array<string>")) for n in lengths]))
    covered = unfold(pieces, PAGE, cut, "hit").distinct()
    left = hits.join(dealt(covered), PAGE + ["hit"], "left_anti")
    return left.select(
        *PAGE, F.col("t.idx").alias("idx"), F.lit(1).alias("n_tokens"), F.col("hit").alias("word"),
        F.col("t.left_x").alias("x0"), F.col("t.top").alias("y0"), (F.col("t.left_x") + F.col("t.width")).alias("x1"),
        (F.col("t.top") + F.col("t.height")).alias("y1"), F.lit("B-DOC").alias("label"))
