"""Every query with a check gives the same rows in DuckDB."""
import pytest
from compare import compare, connect

import veilframe.plans  # noqa: F401
from veilframe.plans.registry import CHECKS, QUERIES


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(spark, folder, duck, name):
    assert compare(spark, duck, folder, QUERIES[name], CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_unchecked_queries_run(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_same_rows_from_more_tasks(spark, folder, duck, monkeypatch):
    """A table too large for the shuffles' tasks is dealt among more, once for each sort."""
    from veilframe.functions import scan
    name = "regex_align_exact"
    monkeypatch.setattr(scan, "TASK_ROWS", 500)
    assert compare(spark, duck, folder, QUERIES[name], CHECKS[name]) is None
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):].split("FileScan")[0]
    assert "page_no" in join.split("\n")[0] and "REPARTITION_BY_NUM" in join
