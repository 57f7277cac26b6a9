"""Operators over detection boxes: checks, pairs, labelling and duplicates."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions import fuzzy, geometry as G
from veilframe.functions import text as T
from veilframe.functions.greedy import dropped_rows
from veilframe.functions.scan import SEGMENT, bands, bind, dealt, exclusive_scan, ordered_fold
from veilframe.session import checkpoint, written

PAGE = ["doc_id", "page_no"]
BOX = ["x0", "y0", "x1", "y1"]


def validate(dets: DataFrame) -> DataFrame:
    """Correct and clip boxes by page size, drop implausible ones."""
    fixed = G.valid_box(*[F.col(c) for c in BOX], F.col("page_w"), F.col("page_h"))
    rest = [c for c in dets.columns if c not in BOX]
    return bind(dets, _b=fixed).where("_b IS NOT NULL").select(*rest, "_b.*")


def expand(dets: DataFrame, kind: str = "page") -> DataFrame:
    """Grow boxes by the padding of their kind, inside the page."""
    grown = G.padded_box(*[F.col(c) for c in BOX], F.col("page_w"), F.col("page_h"), C.BOX_PADDING[kind])
    rest = [c for c in dets.columns if c not in BOX]
    return bind(dets, _b=grown).select(*rest, "_b.*")


def drop_tiny(dets: DataFrame, side: int = C.BOX_MIN_SIDE_V0) -> DataFrame:
    return dets.where((F.col("x1") - F.col("x0") >= side) & (F.col("y1") - F.col("y0") >= side))


def first_of_equal(dets: DataFrame, by: list[str], order: str = "det_no") -> DataFrame:
    """The first detection of every set of equal ones; reduced before the shuffle."""
    rest = [c for c in dets.columns if c not in by]
    first = dets.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return first.select(*by, "_r.*")


def pairs_with_iou(dets: DataFrame, keys: list[str], names: tuple = tuple(BOX), ident: str = "det_no") -> DataFrame:
    """Overlapping pairs inside a page or frame with their IoU."""
    pairs = G.overlapping_pairs(dets, dets, keys, names=names).where(F.col(f"a_{ident}") < F.col(f"b_{ident}"))
    return pairs.withColumn("iou", G.iou(G.box("a_", names), G.box("b_", names)))


def label_tokens(tokens: DataFrame, dets: DataFrame) -> DataFrame:
    """Label of the last detection that touches a token's box, else O."""
    boxed = tokens.select(*PAGE, "pos", F.col("left_x").alias("x0"), F.col("top").alias("y0"),
                          (F.col("left_x") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))
    touched = G.overlapping_pairs(boxed, dets.select(*PAGE, *BOX, "det_no", "label"), PAGE)
    last = touched.groupBy(*PAGE, F.col("a_pos").alias("pos")).agg(F.max_by("b_label", "b_det_no").alias("label"))
    return tokens.join(dealt(last), PAGE + ["pos"], "left").withColumn("label", F.coalesce("label", F.lit("O")))


def without_overlap(extra: DataFrame, base: DataFrame, ident: str) -> DataFrame:
    """Rows of ``extra`` whose box shares no area with any row of ``base``."""
    extra = written(extra, "extra")  # read twice below
    hit = G.overlapping_pairs(extra.select(*PAGE, *BOX, ident), base.select(*PAGE, *BOX), PAGE)
    return extra.join(dealt(hit.select(*PAGE, F.col(f"a_{ident}").alias(ident)).distinct()), PAGE + [ident], "left_anti")


def _look(word: Column) -> Column:
    return F.lower(T.strip(F.coalesce(word, F.lit(""))))


def drop_similar(dets: DataFrame, keys: list[str], rank: Column, ident: str, min_iou: float, min_ratio: int) -> DataFrame:
    """Drop rows that overlap a better kept row and read alike.

    Rows equal in box and text always lose to the first of them, so only firsts
    are compared; pairs come from a grid join and the text score is taken only
    where the boxes agree.
    """
    ranked = dets.withColumn("_rank", F.struct(rank.alias("r"), F.col(ident).alias("i"))).withColumn("_look", _look(F.col("word")))
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    # A box without area overlaps nothing, itself included.
    comparable = ranked.where(solid)
    # Read several times below, so it is written once; rivals are told apart by the number a first gets there.
    firsts = written(comparable.groupBy(*keys, *BOX, "_look").agg(F.min("_rank").alias("_rank")).withColumn("_id", F.monotonically_increasing_id()), "firsts")
    near = G.similar_pairs(firsts, keys, min_iou).where(F.col("a__rank") < F.col("b__rank"))
    la, lb = F.length("a__look"), F.length("b__look")
    # The score cannot exceed what the two lengths allow, so most pairs end here.
    near = near.where(200 * F.least(la, lb) >= (min_ratio + 0.5) * (la + lb))
    alike = (F.col("a__look") == F.col("b__look")) | (fuzzy.ratio_udf("a__look", "b__look") > min_ratio)
    lost = dropped_rows(near.where(alike).select(F.col("a__id").alias("lo"), F.col("b__id").alias("hi")))
    kept = firsts.join(dealt(lost.withColumnRenamed("id", "_id")), "_id", "left_anti").select(*keys, "_rank")
    rest = ranked.where(~solid)
    return ranked.join(dealt(kept), [*keys, "_rank"], "left_semi").unionByName(rest).select(*dets.columns)


def drop_similar_strict(dets: DataFrame) -> DataFrame:
    """Detections by priority; IoU above .85 and ratio above 90 is a duplicate."""
    return drop_similar(dets, PAGE, -F.col("priority"), "det_no", 0.85, 90)


def drop_similar_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of several OCR engines by confidence; IoU above .7 and ratio above 80."""
    boxed = tokens.select("*", F.col("text").alias("word"), F.col("left_x").alias("x0"), F.col("top").alias("y0"),
                          (F.col("left_x") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"))
    return drop_similar(boxed, PAGE, -F.col("conf"), "pos", 0.7, 80).select(*tokens.columns)


def _iou(a: list, b: list) -> float:
    shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    joint = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - shared
    return shared / joint if joint > 0 else 0.0


#: Boxes in a part of a page up to which it is not split any further.
LARGE_BLOCK = 4096


def _split(dets: DataFrame) -> DataFrame:
    """Cut every block at its blank rows (15 px), then those at their blank columns (20 px)."""
    # Numbering bands reads its input twice; writing between the two levels
    # keeps that from multiplying.
    rows = written(bands(dets, [*PAGE, "block"], "y0", F.greatest(F.col("y1"), F.col("y0") + 14), "_row"), "rows")
    rows = bands(rows, [*PAGE, "block", "_row"], "x0", F.greatest(F.col("x1"), F.col("x0")) + 19, "_col")
    return rows.withColumn("block", F.concat_ws("/", "block", "_row", "_col")).drop("_row", "_col")


def merge_blocks(dets: DataFrame) -> DataFrame:
    """Detections with the block of their page outside which nothing can meet them.

    A cut can open another one across it, so blocks of more than ``LARGE_BLOCK`` boxes
    are cut again until none of them falls apart. Every round works on such blocks
    only; all others are done.
    """
    block = [*PAGE, "block"]
    rows, before, done = _split(written(dets.withColumn("block", F.lit("")), "boxes")), 0, None
    while True:
        rows = written(rows, "blocks")
        large = checkpoint(rows.groupBy(*block).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE_BLOCK).drop("_n"))
        here = rows.select(*block).distinct().count() if before else None
        if large.isEmpty() or here == before:
            return rows if done is None else done.unionByName(rows)
        small = rows.join(dealt(large), block, "left_anti")
        done = small if done is None else done.unionByName(small)
        before = large.count()
        rows = _split(rows.join(dealt(large), block, "left_semi"))


class _Near:
    """Numbers of kept boxes by the page cells that they and their surroundings touch."""

    SIDE, MANY = 64, 256

    def __init__(self) -> None:
        self.cells: dict[tuple, set] = {}
        self.wide: set[int] = set()  # boxes over very many cells, looked at always

    def _over(self, box: list, dx: int, dy: int) -> list | None:
        (x0, x1), (y0, y1) = sorted((box[0], box[2])), sorted((box[1], box[3]))
        across = range((x0 - dx) // self.SIDE, (x1 + dx) // self.SIDE + 1)
        down = range((y0 - dy) // self.SIDE, (y1 + dy) // self.SIDE + 1)
        return None if len(across) * len(down) > self.MANY else [(i, j) for i in across for j in down]

    def add(self, number: int, box: list) -> None:
        cells = self._over(box, 20, 15)
        if cells is None:
            self.wide.add(number)
        for cell in cells or ():
            self.cells.setdefault(cell, set()).add(number)

    def around(self, box: list, n: int) -> list[int] | range:
        """Numbers, in order, of all of the ``n`` boxes that may meet this one."""
        cells = self._over(box, 0, 0)
        if cells is None:
            return range(n)
        return sorted(self.wide.union(*(self.cells.get(cell, ()) for cell in cells)))


def merge_by_priority(dets: DataFrame) -> DataFrame:
    """Drop near duplicates and merge neighbours on a line, best priority first.

    A kept box grows while it absorbs others, so rows are handled in order. Pages
    split into blocks that nothing reaches across (``merge_blocks``), each folded
    on its own with nothing but its kept boxes in memory; a box is compared with
    the kept ones around it only, so a block that does not fall apart still takes
    time in proportion to its boxes.
    """
    rest = ["label", "pattern", "priority", "score"]
    rows = merge_blocks(dets.select(*PAGE, "det_no", F.coalesce("word", F.lit("")).alias("word"), *BOX, *rest)).select(
        *PAGE, "block", "det_no", "word", *BOX, *rest)

    def step(state: tuple, row: tuple) -> tuple[tuple, list]:
        kept, near = state
        box, look = [row.x0, row.y0, row.x1, row.y1], row.word.strip().lower()
        for number in near.around(box, len(kept)):
            other = kept[number]
            have, said = other["box"], other["word"].strip().lower()
            if _iou(box, have) > 0.6 and fuzzy.ratio(look, said) > 85:
                return state, []
            gap = min(abs(box[2] - have[0]), abs(have[2] - box[0]))
            if abs(box[1] - have[1]) < 15 and gap < 20:
                other["box"] = [min(box[0], have[0]), min(box[1], have[1]), max(box[2], have[2]), max(box[3], have[3])]
                other["word"] = f"{said} {look}"
                other["n"] += 1
                near.add(number, other["box"])
                return state, []
        near.add(len(kept), box)
        kept.append({"row": row, "box": box, "word": row.word, "n": 1})
        return state, []

    def finish(state: tuple) -> list:
        return [(k["row"].doc_id, k["row"].page_no, k["row"].det_no, k["word"], *k["box"], k["row"].label,
                 k["row"].pattern, k["row"].priority, k["row"].score, k["n"]) for k in state[0]]

    schema = ("doc_id bigint, page_no int, det_no bigint, word string, x0 int, y0 int, x1 int, y1 int, "
              "label string, pattern string, priority int, score double, n_merged int")
    return ordered_fold(rows, [*PAGE, "block"], [F.desc("priority"), F.col("det_no")], lambda: ([], _Near()), step, finish, schema)


def merge_chain(dets: DataFrame) -> DataFrame:
    """Merge boxes that intersect the one before them in (y0, x0) order.

    A box that starts below everything before it cannot intersect, so pages
    split into bands there. The state is the last box and its words.
    """
    banded = bands(dets, PAGE, "y0", F.col("y1") - 1, "band")
    rows = banded.select(*PAGE, "band", "det_no", F.coalesce("word", F.lit("")).alias("word"), *BOX, "label")

    def row_of(state: list) -> tuple:
        first, words, box, n = state
        return (first.doc_id, first.page_no, first.det_no, " ".join(words), *box, first.label, n)

    def step(state: list | None, row: tuple) -> tuple[list, list]:
        if state is not None:
            _, words, have, _ = state
            wide = min(have[2], row.x1) - max(have[0], row.x0)
            high = min(have[3], row.y1) - max(have[1], row.y0)
            if wide > 0 and high > 0:
                words.append(row.word)
                state[2] = [min(have[0], row.x0), min(have[1], row.y0), max(have[2], row.x1), max(have[3], row.y1)]
                state[3] += 1
                return state, []
        return [row, [row.word], [row.x0, row.y0, row.x1, row.y1], 1], [] if state is None else [row_of(state)]

    schema = ("doc_id bigint, page_no int, det_no bigint, word string, x0 int, y0 int, x1 int, y1 int, label string, n_merged int")
    return ordered_fold(rows, [*PAGE, "band"], [F.col("y0"), F.col("x0"), F.col("det_no")], lambda: None, step,
                        lambda s: [row_of(s)] if s else [], schema)


def valid_identifiers(dets: DataFrame) -> DataFrame:
    """Drop Aadhaar and PAN detections whose check fails."""
    word, pattern = F.col("word"), F.coalesce("pattern", F.lit(""))
    bad = (F.col("label") == "B-DOC") & (
        ((pattern == "AADHAAR") & ~T.verhoeff_ok(word)) | ((pattern == "PAN") & ~T.pan_ok(word)))
    return dets.where(~bad)


def features(dets: DataFrame) -> DataFrame:
    """The eleven numbers a gate classifier sees, in fixed order."""
    word = F.coalesce("word", F.lit(""))
    w, h = F.col("page_w"), F.col("page_h")

    def part(of: Column, whole: Column) -> Column:
        return F.when(whole != 0, of / whole).otherwise(F.lit(0.0))

    return dets.withColumns({
        "f_score": F.coalesce("score", F.lit(0.5)), "f_priority": F.coalesce("priority", F.lit(0)),
        "rel_x": part(F.col("x0"), w), "rel_y": part(F.col("y0"), h),
        "rel_width": part(F.col("x1") - F.col("x0"), w), "rel_height": part(F.col("y1") - F.col("y0"), h),
        "word_len": F.length(word), "is_upper": T.is_upper(word).cast("int"), "has_digit": T.has_digit(word).cast("int"),
        "num_tokens": T.word_count(word), "label_id": (T.hash_number(F.col("label")) % 1000).cast("int")})


def overlay(dets: DataFrame, order: str = "det_no") -> DataFrame:
    """Debug overlay: running number on the page, caption and colour per box."""
    colours = F.create_map(*[F.lit(x) for kv in C.OVERLAY_COLOURS.items() for x in kv])
    ranked = exclusive_scan(dets, PAGE, F.floor(F.col(order) / SEGMENT), [order], {"n": ("sum", F.lit(1))})
    return ranked.select(*PAGE, order, *BOX, F.concat_ws(":", (F.col("n") + 1).cast("string"), F.coalesce("pattern", "label")).alias("caption"),
                         F.coalesce(colours[F.col("label")], F.lit(C.OVERLAY_DEFAULT)).alias("colour"),
                         F.greatest(F.lit(0), F.col("y0") - 15).alias("caption_y"))


def number_detections(dets: DataFrame, order: str = "det_no") -> DataFrame:
    """Number a document's detections from 1 through all its pages, page by page.

    Counts are carried over segments of a page, so long documents and pages
    spread out. ``order`` is the integer that orders a page's detections.
    """
    segment = F.col("page_no").cast("bigint") * (1 << 40) + F.floor(F.col(order) / SEGMENT)
    numbered = exclusive_scan(dets, ["doc_id"], segment, ["page_no", order], {"number": ("sum", F.lit(1).cast("bigint"))})
    return numbered.withColumn("number", F.col("number") + 1)


def instructions(dets: DataFrame, level: Column) -> DataFrame:
    """What a renderer has to draw over each box, by redaction level 1 to 4.

    Health data and documents are always blacked out, unless level 4 inpaints.
    """
    drawn = expand(validate(dets.withColumn("level", level)))
    drawn = drawn.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    action = (
        F.when(F.col("level") == 4, "inpaint").when(F.col("label").isin("B-HEALTH", "B-DOC"), "mask")
        .when(F.col("level") == 1, "blur").when(F.col("level") == 2, "mask").when(F.col("level") == 3, "synth"))
    n = F.least(F.lit(8), F.floor((F.col("x1") - F.col("x0")) / 8)).cast("int")
    return drawn.withColumn("action", action).withColumns({
        "fill": F.when(F.col("action") == "mask", "0,0,0").when(F.col("action") == "synth", "255,255,255"),
        "text": F.when(F.col("action") == "synth", F.repeat(F.lit("█"), n))})


def instructions_named(dets: DataFrame, mode: str) -> DataFrame:
    """The older named modes: mask, synth or inpaint every box, whatever its label.

    Corners are put in order and boxes grown; what is still tiny is left out.
    Synth writes the word's stand-in on white.
    """
    if mode not in ("mask", "synth", "inpaint"):
        raise ValueError(f"no redaction mode {mode!r}")
    low, high = [F.least("x0", "x1"), F.least("y0", "y1")], [F.greatest("x0", "x1"), F.greatest("y0", "y1")]
    rest = [c for c in dets.columns if c not in BOX]
    corners = dets.select(*rest, *[c.alias(n) for c, n in zip(low + high, BOX)])
    drawn = drop_tiny(expand(corners, "v1"))
    fill = {"mask": "0,0,0", "synth": "255,255,255", "inpaint": None}[mode]
    text = T.surrogate(F.col("word")) if mode == "synth" else F.lit(None).cast("string")
    return drawn.withColumn("action", F.lit(mode)).withColumn("fill", F.lit(fill).cast("string")).withColumn("text", text)


def union_all(parts: dict[str, DataFrame]) -> DataFrame:
    """All detectors' rows in one table, named by their detector."""
    tables = [df.withColumn("detector", F.lit(name)) for name, df in parts.items()]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
