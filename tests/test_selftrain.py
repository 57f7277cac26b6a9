"""Learning from stored ratings, against plain counts and a plain logistic regression."""
from datetime import datetime

import numpy as np
import pytest
from compare import compare, connect

from veilframe.fixtures import view
from veilframe.operators import boxes, gate, selftrain
from veilframe.plans import report_queries as R
from veilframe.plans.registry import CHECKS, QUERIES

DET = "doc_id bigint, page_no int, det_no bigint, word string, label string, pattern string, score double"
RATING = "det_no bigint, event_id bigint, ts timestamp_ntz, user_feedback boolean"


def plain_fit(x, y, penalty=1.0):
    """Newton steps on the penalised log-likelihood; the intercept is free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    return w


@pytest.fixture(scope="module")
def rated(spark, folder):
    return boxes.features(R.rated_boxes(spark, folder)).toPandas().sort_values("det_no")


def test_gate_is_a_plain_logistic_regression(spark, folder, rated):
    known = rated[rated.user_feedback.notna()]
    w = plain_fit(known[gate.INPUTS].to_numpy(float), known.user_feedback.astype(float).to_numpy())
    chance = 1 / (1 + np.exp(-(rated[gate.INPUTS].to_numpy(float) @ w[:-1] + w[-1])))
    got = {r.det_no for r in QUERIES["gate"](spark, folder).collect()}
    assert 0 < len(got) < len(rated)
    clear = np.abs(chance - 0.5) > 5e-3
    assert clear.mean() > 0.95
    assert {n for n in rated.det_no[clear] if n in got} == set(rated.det_no[clear & (chance > 0.5)])


def test_gate_holds_for_boxes_nobody_rated(spark, folder, rated):
    """Users' own rule (left of a line that differs for places) is met without ever being stated."""
    fresh = rated[rated.user_feedback.isna()]
    assert len(fresh) > 300
    right = np.where(fresh.label == "B-LOC", fresh.x0 < 500, fresh.x0 < 1500)
    got = {r.det_no for r in QUERIES["gate"](spark, folder).collect()}
    kept = fresh.det_no.isin(got).to_numpy()
    assert (kept == right).mean() > 0.8
    assert (kept == right).mean() > max(right.mean(), 1 - right.mean()) + 0.1


def test_next_run(spark, folder):
    assert compare(spark, connect(folder), folder, QUERIES["feedback_next_run"], CHECKS["feedback_next_run"]) is None
    rows = QUERIES["feedback_next_run"](spark, folder).collect()
    before = view(spark, folder, "v_dets").count()
    # Each lesson takes effect: a pattern is off, and scores moved.
    assert "PINCODE" not in {r.pattern for r in rows} and sum(r.origin == "pattern" for r in rows) < before
    assert any(r.calibrated != r.score for r in rows if r.score is not None)


def test_newest_rating_counts(spark):
    dets = spark.createDataFrame([(1, 1, n, "w", "B-PER", None, .5) for n in (1, 2, 3, 4)] + [(1, 1, None, "w", "B-PER", None, .5)], DET)
    at = lambda day: datetime(2024, 1, day)
    ratings = spark.createDataFrame([
        (1, 10, at(1), False), (1, 11, at(2), True), (1, 9, at(2), False),  # newest day, then greatest event
        (2, 12, at(3), True), (2, 13, at(4), None),                         # taken back
        (3, 14, None, False), (3, 14, None, False),                         # no time, repeated
        (99, 15, at(1), True), (None, 16, at(1), True)], RATING)
    got = {r.det_no: r.user_feedback for r in selftrain.rate(dets, ratings).collect()}
    assert got == {1: True, 2: None, 3: False, 4: None, None: None}
    assert selftrain.rate(dets, ratings).count() == 5
    empty = spark.createDataFrame([], RATING)
    lessons = selftrain.learn(selftrain.rate(dets, empty).selectExpr(
        "*", "90 priority", "0 x0", "0 y0", "9 x1", "9 y1", "100 page_w", "100 page_h"))
    assert lessons.model is None and lessons.disabled.count() == lessons.shifts.count() == lessons.history.count() == 0


def test_earlier_lessons_stay(spark):
    dets = spark.createDataFrame([(1, 1, n, "w", "B-LOC", "PINCODE", None) for n in range(6)], DET)
    ratings = spark.createDataFrame([(n, n, datetime(2024, 1, 1), n == 0) for n in range(6)], RATING)
    stored = spark.createDataFrame([("PAN",), ("PINCODE",)], "pattern string")
    raised = spark.createDataFrame([("B-LOC", .1), ("B-PER", .1)], "label string, shift double")
    lessons = selftrain.learn(selftrain.rate(dets, ratings), stored, raised, gated=False)
    assert sorted(r.pattern for r in lessons.disabled.collect()) == ["PAN", "PINCODE"]
    assert dict(lessons.shifts.collect()) == {"B-LOC": .3, "B-PER": .1}


def test_truncated_texts(spark):
    from veilframe.operators import text
    docs = spark.createDataFrame([(1, "é" * 5001), (2, ""), (3, None), (4, "a" * 5000)], "id int, text string")
    got = {r.id: (r.text, r.cut) for r in text.truncate(docs).collect()}
    assert got == {1: ("é" * 5000, 1), 2: ("", 0), 3: (None, None), 4: ("a" * 5000, 0)}
