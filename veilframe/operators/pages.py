"""Page-level choices made from OCR results."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_rotation(conf: DataFrame) -> DataFrame:
    """The rotation with the highest mean confidence, the smaller one on a tie.

    Unread words (confidence -1) do not count; a page without any reading
    stays as it is.
    """
    read = F.when(F.col("conf") != -1, F.col("conf"))
    means = conf.groupBy("page_id", "rotation").agg(F.coalesce(F.sum(read) / F.count(read), F.lit(0.0)).alias("mean_conf"))
    best = means.groupBy("page_id").agg(F.max(F.struct("mean_conf", (-F.col("rotation")).alias("neg"))).alias("b"))
    return best.select("page_id", F.when(F.col("b.mean_conf") > 0, -F.col("b.neg")).otherwise(0).alias("rotation"), F.col("b.mean_conf").alias("mean_conf"))
