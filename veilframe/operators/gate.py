"""A gate that keeps detections a trained classifier believes in."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import catalogue as C

INPUTS = [{"score": "f_score", "priority": "f_priority"}.get(name, name) for name in C.FEATURES]


def train(rated: DataFrame) -> PipelineModel | None:
    """Fit on rated detections with features; nothing below twenty samples.

    The penalty is that of a unit-strength ridge on the sum of losses.
    """
    known = rated.where(F.col("user_feedback").isNotNull()).withColumn("target", F.col("user_feedback").cast("double"))
    facts = known.agg(F.count("*").alias("n"), F.countDistinct("target").alias("classes")).first()
    if facts.n < C.GATE_MIN_SAMPLES or facts.classes < 2:
        return None
    vector = VectorAssembler(inputCols=INPUTS, outputCol="features")
    model = LogisticRegression(featuresCol="features", labelCol="target", maxIter=1000, standardization=False, regParam=1.0 / facts.n)
    return Pipeline(stages=[vector, model]).fit(known.select("target", *INPUTS))


def apply(dets: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Detections with a probability above one half; all of them without a model."""
    if model is None:
        return dets
    scored = model.transform(dets).withColumn("gate", vector_to_array("probability")[1])
    return scored.where(F.col("gate") > C.GATE_PROBABILITY).select(*dets.columns, "gate")
