"""Mixing sources to target weights along a time-varying curriculum.

Targets come from water filling over the sources: each gets its weight's part
of the budget, capped at twice its size. Within a source documents lie in a
seeded order; the mix takes the source's target in words from that line, going
round a second time where the target exceeds the source. Every source has a
schedule of weights over training time from 0 to 1. Its integral is the source's
cumulative demand; inverting that at the words before a document gives the
document's training position, and documents are range-sorted by position.

Running sums are cut into segments of bounded length, so a source with any
share of the rows is spread over tasks. Sources of a corpus are counted, not
documents, wherever a window sees all of them.

Defined results: a null or blank text has size 0 and takes 0 words; a null source
is a source of its own and comes last; sources without words have target 0;
repeated rows each count; an empty table gives an empty result; other columns are
neither read nor changed. Reruns agree because the order is a hash of doc_id,
then size and text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.llm.common import documents, n_words
from veilframe.llm.registry import query
from veilframe.session import checkpoint

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
#: Weight over training time as (time, weight) knots, for the first, second and
#: third kind of source in turn: falling, even, rising.
SCHEDULES = (((0.0, 2.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0)))
#: Rows of one segment of a running sum, about.
SEGMENT = 50_000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """Each source's target in words: least(repeats * size, weight * level).

    The level is where the targets use up the budget. Sources are capped in
    the order of cap by weight, so the level follows from running sums over
    that order. One row per source comes in and goes out.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    kind = F.pmod(place, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), kind + 1)
    cap = (F.col("source_size") * repeats).cast("double")
    t = sizes.select("source", "source_size", kind.alias("kind"), weight.alias("weight"), cap.alias("cap"))
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*", (F.sum("source_size").over(everything) * budget).alias("all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    # With everything before this source capped, would it stay below its cap?
    level = (F.col("all") - F.col("capped")) / F.col("open")
    t = t.withColumn("level", F.when(level <= F.col("ratio"), level))
    first = F.max("level").over(everything)
    return t.select("source", "source_size", "kind", F.when(
        first.isNull() | (F.col("weight") * first >= F.col("cap")), F.col("cap")).otherwise(F.col("weight") * first).alias("target"))


def _position(share: Column, schedules: tuple) -> Column:
    """Training time at which a source has met this share of its demand."""
    out = F.when(F.lit(False), F.lit(0.0))
    for kind, knots in enumerate(schedules):
        spans = list(zip(knots, knots[1:]))
        areas = [(b - a) * (v + w) / 2 for (a, v), (b, w) in spans]
        total, before, here = sum(areas), 0.0, F.when(F.lit(False), F.lit(0.0))
        for n, (((a, v), (b, w)), area) in enumerate(zip(spans, areas)):
            slope, rest = (w - v) / (b - a), share * total - before
            # Solve v x + slope x^2 / 2 = rest for the time x after the knot.
            x = rest / v if slope == 0 else (F.sqrt(F.greatest(F.lit(v * v) + F.lit(2 * slope) * rest, F.lit(0.0))) - v) / slope
            at = F.lit(a) + F.greatest(F.lit(0.0), F.least(x, F.lit(b - a)))
            before += area
            here = here.when(share * total < before, at) if n + 1 < len(spans) else here.otherwise(at)
        out = out.when(F.col("kind") == kind, here)
    return out


def mix(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS,
        schedules: tuple = SCHEDULES) -> DataFrame:
    """Every row with its size, its source's size and target, the words the mix
    takes of it and the training position of each of its turns."""
    rows = checkpoint(docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("body"),
        F.md5(F.col("doc_id").cast("string")).alias("seat")))
    # Seats are hex digits of a hash, so their leading digits cut a source evenly.
    pieces = max(1, rows.count() // SEGMENT)
    leading = F.conv(F.substring(F.coalesce("seat", F.lit("0")), 1, 8), 16, 10).cast("bigint")
    rows = rows.select("*", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("_key"),
                       F.floor(leading * pieces / F.lit(1 << 32)).alias("_seg"))
    inside = Window.partitionBy("_key", "_seg").orderBy("seat", "doc_id", "size", "body")
    local = rows.withColumn("_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    # One row per segment carries the sum, the source's size and its target.
    totals = rows.groupBy("_key", "_seg").agg(F.sum("size").alias("_words"), F.first("source").alias("source"))
    sizes = totals.groupBy("_key").agg(F.sum("_words").alias("source_size"), F.first("source").alias("source"))
    plan = targets(sizes, weights, budget, repeats).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("_key"), "source_size", "kind", "target")
    along = Window.partitionBy("_key").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_key", "_seg", F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_car")).join(plan, "_key")
    placed = local.join(carried, ["_key", "_seg"]).withColumn("before", F.col("_car") + F.coalesce("_in", F.lit(0)))
    # Words of the document that lie within the target in its k-th turn.
    start = [F.col("before") + k * F.col("source_size") for k in range(repeats)]
    turns = [F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("bigint") - at)) for at in start]
    taken = turns[0]
    for t in turns[1:]:
        taken = taken + t
    positions = F.array(*[F.when(t > 0, _position(at / F.col("target"), schedules)) for at, t in zip(start, turns)])
    return placed.select("doc_id", "source", "body", "size", "source_size", "target", taken.cast("bigint").alias("taken"),
                         F.filter(positions, lambda x: x.isNotNull()).alias("positions"))


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row for each turn of a document, range-sorted into
    training order, with the documents' own columns.

    Documents stay whole: a turn that the target cuts is kept if at least
    half of it is taken. Rows that repeat one document share its turns evenly,
    and one of them takes what is left over.
    """
    plan = checkpoint(mix(docs, **how))
    whole = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("bigint")
    pooled = plan.groupBy(
        F.col("doc_id").alias("_vf_id"), F.col("source").alias("_vf_source"), F.col("body").alias("_vf_body")).agg(
        F.count("*").alias("_vf_rows"), F.sum(whole).alias("_vf_turns"), F.max("positions").alias("_vf_at")).filter("_vf_turns > 0")
    names = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select("*", F.xxhash64("text").alias("_vf_own"))
    same = F.col("doc_id").eqNullSafe(F.col("_vf_id")) & F.col("source").eqNullSafe(F.col("_vf_source")) & (F.col("_vf_own") == F.col("_vf_body"))

    def turns(met: DataFrame, n: Column) -> DataFrame:
        each = met.filter(n > 0).select("*", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("_vf_turn"))
        at = F.coalesce(F.get("_vf_at", F.col("_vf_turn") - 1), F.element_at("_vf_at", -1))
        return each.select(*names, at.alias("_vf_position"))

    mixed = turns(own.join(pooled, same), F.floor(F.col("_vf_turns") / F.col("_vf_rows")))
    left = F.col("_vf_turns") % F.col("_vf_rows")
    if not pooled.filter(left > 0).isEmpty():
        uneven = own.join(pooled.filter(left > 0), same).dropDuplicates(["_vf_id", "_vf_source", "_vf_body"])
        mixed = mixed.unionByName(turns(uneven, left))
    return mixed.orderBy("_vf_position").select(*names)


def _case(schedules: tuple) -> str:
    """The inverse of each schedule's integral, in SQL."""
    out = []
    for kind, knots in enumerate(schedules):
        areas = [(b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:])]
        total, before, arms = sum(areas), 0.0, []
        for (a, v), (b, w), area in zip(knots, knots[1:], areas):
            slope, rest = (w - v) / (b - a), f"(share * {total!r}::DOUBLE - {before!r}::DOUBLE)"
            x = f"{rest} / {v!r}::DOUBLE" if slope == 0 else (
                f"(sqrt(greatest({v * v!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE)) - {v!r}::DOUBLE) / {slope!r}::DOUBLE")
            before += area
            arms.append((f"share * {total!r}::DOUBLE < {before!r}::DOUBLE",
                         f"{a!r}::DOUBLE + greatest(0.0::DOUBLE, least({x}, {b - a!r}::DOUBLE))"))
        inner = "".join(f" WHEN {test} THEN {value}" for test, value in arms[:-1])
        value = f"CASE{inner} ELSE {arms[-1][1]} END" if inner else arms[-1][1]
        out.append(f" WHEN kind = {kind} THEN {value}")
    return f"CASE{''.join(out)} END"


CHECK = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS kind
  FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][kind + 1]::DOUBLE AS weight, (source_size * 2)::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS everything,
  coalesce(sum(cap) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM r),
l AS (SELECT *, max(CASE WHEN (everything - capped) / open <= ratio THEN (everything - capped) / open END) OVER () AS level FROM o),
t AS (SELECT source, source_size, kind, CASE WHEN level IS NULL OR weight * level >= cap THEN cap ELSE weight * level END AS target FROM l),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
q AS (SELECT p.*, source_size, kind, target,
  greatest(0, least(size, round(target)::BIGINT - before)) AS one,
  greatest(0, least(size, round(target)::BIGINT - before - source_size)) AS two,
  before / target AS share FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size::BIGINT AS size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN one > 0 THEN {_case(SCHEDULES)} END AS position FROM q
"""


@query("op8_mixing", CHECK)
def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(documents(spark, folder)).withColumn("position", F.get("positions", F.lit(0))).drop("positions", "body")
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")
