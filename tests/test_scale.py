"""Plans and hot keys: what must hold when one key holds most of the rows."""
import pytest
from pyspark.sql import functions as F

import veilframe.plans  # noqa: F401
from veilframe import catalogue as C
from veilframe.functions.greedy import dropped_rows
from veilframe.operators import boxes, tokens
from veilframe.plans.registry import QUERIES

EAGER = {"dedup_strict", "dedup_tokens", "box_vote", "gate"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_products(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_files(spark, folder):
    plan = QUERIES["frame_sample"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_tax" not in plan


def test_text_redaction_needs_no_shuffle(spark, folder):
    from veilframe.operators import text
    df = spark.read.parquet(f"{folder}/documents.parquet")
    plan = text.redact(text.detect(df), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_greedy_chain(spark):
    # A path: every second row loses. A star: all but the centre lose.
    edges = [(i, i + 1) for i in range(0, 20)] + [(100, 100 + i) for i in range(1, 50)] + [(101, 130), (130, 140)]
    lost = {r.id for r in dropped_rows(spark.createDataFrame(edges, "lo int, hi int")).collect()}
    assert lost == set(range(1, 21, 2)) | set(range(101, 150))


def test_copies_collapse_before_pairs(spark):
    rows = spark.range(20000).selectExpr(
        "1L doc_id", "1 page_no", "id det_no", "'same' word", "10 x0", "10 y0", "90 x1", "30 y1", "'B-PER' label", "75 priority")
    assert [r.det_no for r in boxes.drop_similar_strict(rows).collect()] == [0]


def test_one_page_with_everything(spark):
    rows = spark.range(200000).selectExpr(
        "1L doc_id", "1 page_no", "id pos", "CASE WHEN id % 1000 = 0 THEN 'DOB' WHEN id % 1000 = 1 THEN '12/03/1999' ELSE 'word' END text",
        "cast(60 + (id % 8) * 120 as int) left_x", "cast(40 + (id div 8) % 100 * 30 as int) top", "50 width", "20 height", "90 conf")
    numbered = tokens.number_tokens(rows)
    assert numbered.where("idx <> pos").count() == 0
    found = tokens.field_values(numbered).where("pattern = 'DOB_FIELD'")
    assert found.count() == 200
    dates = [p for p in C.ID_PATTERNS if p.name == "DOB"]
    assert tokens.match_windows(rows.withColumn("idx", F.col("pos")), dates, segment=1000).count() == 0
