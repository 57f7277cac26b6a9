"""Ordered scans that never put one hot key into one task.

A plain window over a key sorts that key's rows in a single task. Here rows
are first cut into segments of bounded length; each segment is scanned on its
own, and one total per segment carries the result across segments. With 65536
rows to a segment, a key of a trillion rows has some fifteen million totals.
"""
from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.session import checkpoint

SEGMENT = 65536
#: Rows that one task sorts for a window or a join.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame) -> int | None:
    """Tasks among which a large table is dealt, so that what each sorts stays bounded.

    The number of shuffle partitions is fixed, so a task's share grows with the table.
    None while that number gives shares of at most ``TASK_ROWS``.
    """
    wanted = -(-df.count() // TASK_ROWS)
    return wanted if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def among(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt by the keys among so many tasks, or as they are."""
    return df.repartition(tasks, *keys) if tasks else df


def _exclusive(kind: str, value: Column, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "sum":
        return F.coalesce(F.sum(value).over(before), F.lit(0))
    return F.max(value).over(before)


def dealt(df: DataFrame) -> DataFrame:
    """A side of an equi-join whose rows are dealt out by the key, as the other side's are.

    Sizes are estimated from the files' bytes, and views and generators make many rows
    of one; without this a large side may be taken for a small one, collected by
    the driver and broadcast.
    """
    return df.hint("merge")


def exclusive_scan(
    df: DataFrame, keys: list[str], segment: Column, order: list[str],
    measures: dict[str, tuple[str, Column]], tasks: int | None = None,
) -> DataFrame:
    """Add running ``sum`` or ``max`` over all earlier rows of the key.

    ``segment`` is an integer that does not fall along ``order``. The value of
    each measure excludes the current row; a sum starts at 0, a max at null. Segments
    are dealt among ``tasks``, where given.
    """
    inputs = [f"_in_{name}" for name in measures]
    df = df.select("*", segment.cast("bigint").alias("_seg"),
                   *[value.alias(i) for i, (_, value) in zip(inputs, measures.values())])
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    local = among(df, tasks, *keys, "_seg").select("*", *[
        _exclusive(kind, F.col(i), inside).alias(f"_loc_{name}")
        for i, (name, (kind, _)) in zip(inputs, measures.items())])
    totals = df.groupBy(*keys, "_seg").agg(*[
        (F.sum(i) if kind == "sum" else F.max(i)).alias(f"_tot_{name}")
        for i, (name, (kind, _)) in zip(inputs, measures.items())])
    over = Window.partitionBy(*keys).orderBy("_seg")
    carried = totals.select(*keys, "_seg", *[
        _exclusive(kind, F.col(f"_tot_{name}"), over).alias(f"_car_{name}") for name, (kind, _) in measures.items()])
    out = local.join(dealt(carried), keys + ["_seg"], "left")
    results = []
    for name, (kind, _) in measures.items():
        loc, car = F.col(f"_loc_{name}"), F.col(f"_car_{name}")
        results.append((loc + F.coalesce(car, F.lit(0)) if kind == "sum" else F.greatest(loc, car)).alias(name))
    kept = [c for c in df.columns if c not in inputs and c != "_seg"]
    return out.select(*kept, *results)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however often they are used.

    The optimiser copies a plain column into every later filter and projection
    that names it. It does not look through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def unfold(df: DataFrame, keep: list, value: Column, name: str | None = None) -> DataFrame:
    """One row per element of a computed array; structs become columns unless
    ``name`` is given. The array is computed once: a bare generator would get a
    copy of it in front that tests for emptiness."""
    bound = bind(df, _list=value)
    return bound.select(*keep, F.explode("_list").alias(name) if name else F.inline("_list"))


def bands(
    df: DataFrame, keys: list[str], low: str, high: Column, out: str, slack: Column | None = None,
) -> DataFrame:
    """Number the stretches of an axis that touch each other.

    A new band begins where ``low`` passes the largest ``high`` (plus the
    row's ``slack``) seen before it. Rows are first reduced to one per
    distinct integer ``low``, so the scan is as long as the axis, not as the
    number of rows.
    """
    slack = F.lit(0) if slack is None else slack
    axis = df.groupBy(*keys, low).agg(F.max(high).alias("_hi"), F.max(slack).alias("_slack"))
    along = Window.partitionBy(*keys).orderBy(low)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    axis = axis.withColumn("_reach", F.max("_hi").over(before))
    fresh = F.when(F.col(low) > F.col("_reach") + F.col("_slack"), 1).otherwise(0)
    axis = axis.withColumn(out, F.sum(fresh).over(along).cast("int"))
    return df.join(dealt(axis.select(*keys, low, out)), keys + [low])


def islands(
    df: DataFrame, keys: list[str], start: str, end: str, segment: Column,
) -> DataFrame:
    """Join intervals that overlap or touch, per key.

    Equal starts are reduced first; segments keep a long key spread out. Each
    scan reads its input twice, so the reduced intervals are written once.
    """
    base = checkpoint(df.groupBy(*keys, start).agg(F.max(end).alias(end)))
    reach = exclusive_scan(base, keys, segment, [start], {"_reach": ("max", F.col(end))})
    fresh = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    marked = checkpoint(reach.withColumn("_fresh", fresh))
    numbered = exclusive_scan(marked, keys, segment, [start], {"_before": ("sum", F.col("_fresh"))})
    return (
        numbered.withColumn("_island", F.col("_before") + F.col("_fresh"))
        .groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end))
        .drop("_island")
    )


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[Column],
    begin: Callable[[], object], step: Callable[[object, tuple], tuple[object, list]],
    finish: Callable[[object], list], schema: str,
) -> DataFrame:
    """Run a small state machine over the ordered rows of every group.

    Rows stream through the task batch by batch: memory holds one batch and
    one group's state, never a whole group. Rows arrive as named tuples;
    ``step`` returns the new state and the finished output rows, ``finish`` the
    rows left at the end of a group.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def plain(values: pd.Series) -> list:
        return values.astype(object).where(values.notna(), None).tolist() if values.hasnans else values.tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        record = namedtuple("Row", columns)
        current, state = None, None
        for batch in batches:
            out: list = []
            for row in map(record._make, zip(*[plain(batch[c]) for c in columns])):
                key = tuple(row[i] for i in at)
                if key != current:
                    if current is not None:
                        out.extend(finish(state))
                    current, state = key, begin()
                state, done = step(state, row)
                out.extend(done)
            if out:
                yield pd.DataFrame(out, columns=names)
        if current is not None:
            rest = finish(state)
            if rest:
                yield pd.DataFrame(rest, columns=names)

    placed = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    return placed.mapInPandas(run, schema)
