"""Column expressions over boxes given as four integer columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import catalogue as C
from veilframe.functions.scan import dealt
from veilframe.session import checkpoint


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def overlap(a: tuple, b: tuple) -> Column:
    """Shared area of two boxes."""
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou(a: tuple, b: tuple) -> Column:
    """Shared area over joint area, 0 where the joint area is not positive."""
    shared = overlap(a, b)
    joint = area(*a) + area(*b) - shared
    return F.when(joint > 0, shared.cast("double") / joint.cast("double")).otherwise(F.lit(0.0))


def box(prefix: str = "", names: tuple = ("x0", "y0", "x1", "y1")) -> tuple:
    return tuple(F.col(prefix + n) for n in names)


def valid_box(x0, y0, x1, y1, width, height) -> Column:
    """Sorted, clipped box as a struct, or null if its size is implausible."""
    def clip(value: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(value, most)).cast("int")

    box = F.struct(clip(F.least(x0, x1), width - 1).alias("x0"), clip(F.least(y0, y1), height - 1).alias("y0"),
                   clip(F.greatest(x0, x1), width).alias("x1"), clip(F.greatest(y0, y1), height).alias("y1"))

    def check(b: Column) -> Column:
        w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
        return F.when(
            (w >= C.BOX_MIN_SIDE) & (h >= C.BOX_MIN_SIDE) & (w <= C.BOX_MAX_WIDTH) & (h <= C.BOX_MAX_HEIGHT)
            & (w * h <= C.BOX_MAX_AREA) & (w <= h * C.BOX_MAX_ASPECT) & (h <= w * C.BOX_MAX_ASPECT), b)

    # The lambda names the clipped box once; written out, it would repeat in
    # every comparison and outgrow the code generator.
    return F.get(F.transform(F.array(box), check), 0)


def padded_box(x0, y0, x1, y1, width, height, pad: int) -> Column:
    return F.struct(
        F.greatest(F.lit(0), x0 - pad).cast("int").alias("x0"), F.greatest(F.lit(0), y0 - pad).cast("int").alias("y0"),
        F.least(width, x1 + pad).cast("int").alias("x1"), F.least(height, y1 + pad).cast("int").alias("y1"))


def clipped_box(x0, y0, x1, y1, width, height) -> Column:
    """Clip to the frame; null if nothing is left."""
    cx0, cy0 = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0)
    cx1, cy1 = F.least(width, x1), F.least(height, y1)
    return F.when((cx1 > cx0) & (cy1 > cy0), F.struct(
        cx0.cast("int").alias("x0"), cy0.cast("int").alias("y0"),
        cx1.cast("int").alias("x1"), cy1.cast("int").alias("y1")))


def union_box(boxes: Column) -> Column:
    """Smallest box around an array of box structs; null for an empty array."""
    def side(name: str, pick) -> Column:
        return pick(boxes[name]).alias(name)

    return F.when(F.size(boxes) > 0, F.struct(
        side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max)))


def cells(x0: Column, y0: Column, x1: Column, y1: Column, size: int) -> Column:
    """Grid cells a box touches, as (cx, cy) structs."""
    def steps(lo: Column, hi: Column) -> Column:
        return F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))

    return F.flatten(F.transform(steps(x0, x1), lambda cx: F.transform(
        steps(y0, y1), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def overlapping_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], size: int = 128,
    how_many_once: bool = True, names: tuple = ("x0", "y0", "x1", "y1"),
) -> DataFrame:
    """Rows of two tables whose boxes share area, by an equi-join on grid cells.

    Columns come out prefixed ``a_`` and ``b_``. A pair meets in every cell
    both boxes touch; it is kept only in the cell of the upper left corner of
    the shared area, so no distinct is needed. A busy page spreads over its
    cells, which keeps any one join key small.
    """
    def spread(df: DataFrame, prefix: str) -> DataFrame:
        cols = [F.col(c).alias(prefix + c) for c in df.columns if c not in keys]
        return df.select(*keys, *cols, F.explode(cells(*box("", names), size)).alias("cell"))

    a, b = spread(left, "a_"), spread(right, "b_")
    pairs = a.join(dealt(b), keys + ["cell"])
    ax, bx = box("a_", names), box("b_", names)
    if how_many_once:
        pairs = pairs.where(
            (F.floor(F.greatest(ax[0], bx[0]) / size) == F.col("cell.cx"))
            & (F.floor(F.greatest(ax[1], bx[1]) / size) == F.col("cell.cy")))
    return pairs.where(overlap(ax, bx) > 0).drop("cell")


#: Boxes of one page or frame up to which all that overlap are compared.
QUIET = 256


def similar_pairs(
    dets: DataFrame, keys: list[str], least: float, names: tuple = ("x0", "y0", "x1", "y1"), quiet: int = QUIET,
) -> DataFrame:
    """Pairs of boxes, in either order, with an IoU above ``least``.

    Pages of up to ``quiet`` boxes compare those with near centres, so a box meets no more
    than that many. Busier pages, found by counting, join on shape instead. The
    pairs are the same either way; columns come out prefixed ``a_`` and ``b_``.
    """
    busy = checkpoint(dets.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > quiet).select(*keys))
    if busy.isEmpty():
        return _close_centres(dets, keys, least, names)
    few, many = dets.join(busy, keys, "left_anti"), dets.join(busy, keys, "left_semi")
    return _close_centres(few, keys, least, names).unionByName(_alike_in_shape(many, many, keys, least, names))


def _close_centres(dets: DataFrame, keys: list[str], least: float, names: tuple, size: int = 128) -> DataFrame:
    """Pairs of boxes, in either order, with an IoU above ``least``, from cells of their centres.

    On either axis the IoU is at most the shared stretch over the larger side, so centres
    are no further apart than a fixed share of either box's own side. A box is dealt to the
    cells within that distance, once, and meets there those whose centre the cell holds, so
    a pair meets once. A cell holds no more boxes than its page, which is a quiet one.
    """
    reach = max(1 - least, (1 / least - 1) / 2) * 1.001  # a margin for rounding
    x0, y0, x1, y1 = box("", names)

    def cell(lo: Column, hi: Column, share: float) -> Column:
        return F.floor(((lo + hi) / 2 + (hi - lo) * share) / size).cast("int")

    # The outer kind of generator, as an inner one gets a copy of its array in front that tests for emptiness.
    near = [F.sequence(cell(lo, hi, -reach), cell(lo, hi, reach)) for lo, hi in ((x0, x1), (y0, y1))]
    every = F.flatten(F.transform(near[0], lambda x: F.transform(near[1], lambda y: F.struct(x.alias("_c_x"), y.alias("_c_y")))))
    out = dets.where((x1 > x0) & (y1 > y0)).select("*", F.inline_outer(every))
    own = (F.col("_c_x") == cell(x0, x1, 0.0)) & (F.col("_c_y") == cell(y0, y1, 0.0))
    rest = [c for c in dets.columns if c not in keys]
    met = out.groupBy(*keys, "_c_x", "_c_y").agg(F.collect_list(F.struct(own.alias("_own"), *rest)).alias("_all"))

    def touches(a: Column, b: Column) -> Column:
        return (a[names[0]] < b[names[2]]) & (b[names[0]] < a[names[2]]) & (a[names[1]] < b[names[3]]) & (b[names[1]] < a[names[3]])

    both = F.flatten(F.transform(F.filter("_all", lambda a: a["_own"]), lambda a: F.transform(
        F.filter("_all", lambda b: touches(a, b)), lambda b: F.struct(a.alias("_a"), b.alias("_b")))))
    pairs = met.select(*keys, F.inline_outer(both)).where("_a IS NOT NULL")
    pairs = pairs.select(*keys, *[F.col(f"_{p}.{c}").alias(f"{p}_{c}") for p in "ab" for c in rest])
    return pairs.withColumn("iou", iou(box("a_", names), box("b_", names))).where(F.col("iou") > least)


def _alike_in_shape(left: DataFrame, right: DataFrame, keys: list[str], least: float, names: tuple) -> DataFrame:
    """Rows of two tables whose boxes have an IoU above ``least``, by an equi-join on shape.

    Such boxes have widths and heights in a ratio above ``least`` and centres no
    further apart than the larger side times ``1 - least``. So a box is keyed by
    the logarithm of its sides, the next larger class included, and by a cell of
    its centre as large as that distance; the other side lists the few cells in
    reach. However many boxes a page holds, only like ones in like places meet.
    Columns come out prefixed ``a_`` and ``b_`` with the pair's ``iou``; boxes
    without area match nothing.
    """
    base = 1 / (least * 0.999)  # a margin for rounding at class borders
    reach = 1 - least * 0.999

    def spread(df: DataFrame, prefix: str, wide: bool) -> DataFrame:
        x0, y0, x1, y1 = box("", names)
        out = df.where((x1 > x0) & (y1 > y0))
        cols = [F.col(c).alias(prefix + c) for c in df.columns if c not in keys]
        for axis, lo, hi in (("x", x0, x1), ("y", y0, y1)):
            own = F.floor(F.log(hi - lo) / F.log(F.lit(base))).cast("int")
            out = out.withColumn(f"_own_{axis}", own).withColumn(f"_g_{axis}", F.explode(F.array(own, own + 1)))
            edge = F.pow(F.lit(base), F.col(f"_g_{axis}") + 1) * reach
            middle = (lo + hi) / 2
            first, last = [F.floor((middle + shift) / edge).cast("int") for shift in ((-edge, edge) if wide else (F.lit(0.0),) * 2)]
            out = out.withColumn(f"_c_{axis}", F.explode(F.sequence(first, last)) if wide else first)
        own = [F.col(f"_own_{axis}").alias(f"{prefix}_own_{axis}") for axis in "xy"]
        return out.select(*keys, *cols, *own, "_g_x", "_g_y", "_c_x", "_c_y")

    grid = ["_g_x", "_g_y", "_c_x", "_c_y"]
    pairs = spread(left, "a_", False).join(dealt(spread(right, "b_", True)), [*keys, *grid])
    # A pair meets once: in the class of its larger side.
    for axis in "xy":
        pairs = pairs.where(F.col(f"_g_{axis}") == F.greatest(f"a__own_{axis}", f"b__own_{axis}"))
    pairs = pairs.drop(*grid, *[f"{p}__own_{axis}" for p in "ab" for axis in "xy"])
    return pairs.withColumn("iou", iou(box("a_", names), box("b_", names))).where(F.col("iou") > least)
