"""Greedy selection without per-group loops.

"Walk rows in order, drop a row that conflicts with a kept one" has one
well-defined result: the first maximal independent set of the conflict graph.
It is computed here from the list of conflicts in parallel rounds. A round
keeps every row none of whose earlier rivals is still open, and drops the
rivals of kept rows. Rows without conflicts never enter the rounds at all.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.scan import dealt
from veilframe.session import written


def dropped_rows(conflicts: DataFrame) -> DataFrame:
    """Rows that lose, given distinct pairs (``lo``, ``hi``) with lo before hi.

    Each round writes its open pairs to the shared folder, so lost
    executors cost one round at most and the plan stays short. The number of
    rounds is the longest chain of rows that wait for each other.
    """
    open_pairs = written(conflicts.select("lo", "hi"), "pairs")
    lost: DataFrame | None = None
    while not open_pairs.isEmpty():
        heads = open_pairs.select(F.col("lo").alias("id")).distinct().join(
            dealt(open_pairs.select(F.col("hi").alias("id")).distinct()), "id", "left_anti")
        out = written(open_pairs.join(dealt(heads), F.col("lo") == F.col("id"), "left_semi").select(F.col("hi").alias("id")).distinct(), "lost")
        lost = out if lost is None else lost.unionByName(out)
        rest = open_pairs.join(dealt(out), F.col("lo") == F.col("id"), "left_anti")
        open_pairs = written(rest.join(dealt(out), F.col("hi") == F.col("id"), "left_anti"), "pairs")
    if lost is None:
        return open_pairs.select(F.col("lo").alias("id"))
    return lost
