from collections import Counter

import pytest

from verdictflow.operators import evaluate

ROWS = [(1, 1)] * 5 + [(1, 2)] * 2 + [(2, 2)] * 3 + [(2, 0)] + [(None, 1)]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(ROWS, "target_real int, predicao int")


def test_confusion_matrix(scored):
    assert {tuple(r) for r in evaluate.confusion_matrix(scored).collect()} == {(*pair, n) for pair, n in Counter(ROWS).items()}


def test_agreement_rate(scored):
    row = evaluate.agreement_rate(scored).first()
    assert tuple(row) == (12, 8, 1, 0.666667, 0.083333)


def test_agreement_rate_of_nothing(scored):
    assert tuple(evaluate.agreement_rate(scored.where("false")).first()) == (0, 0, 0, None, None)


def test_prediction_profile(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 0)], "purpose string, predicao int")
    assert {tuple(r) for r in evaluate.prediction_profile(rows, "purpose").collect()} == {("a", 1, 2), ("a", 2, 1), ("b", 0, 1)}
    assert {tuple(r) for r in evaluate.prediction_profile(rows).collect()} == {(1, 2), (2, 1), (0, 1)}


def test_backlog_counts_replayed_rows(spark):
    raw = spark.createDataFrame([(i,) for i in [1, 1, 1, 2, 2, 3, 4, None]], "id int")
    scored = spark.createDataFrame([(i,) for i in [1, 2, 2, 4, 4, 5]], "id int")
    found = {tuple(r) for r in evaluate.backlog(raw, scored, "id").collect()}
    assert found == {(1, 3, 1, 2), (3, 1, 0, 1), (None, 1, 0, 1)}


def test_backlog_against_brute_force_with_a_hot_key(spark):
    raw = [i % 50 for i in range(1000)] + [7] * 500
    scored = [i % 40 for i in range(900)] + [7] * 200
    frames = [spark.createDataFrame([(i,) for i in ids], "id int").repartition(5) for ids in (raw, scored)]
    arrived, done = Counter(raw), Counter(scored)
    expected = {(i, n, done[i], n - done[i]) for i, n in arrived.items() if n > done[i]}
    assert {tuple(r) for r in evaluate.backlog(*frames, "id").collect()} == expected


def test_reports_sum_before_they_shuffle(spark, scored):
    rows = spark.range(10).selectExpr("id", "1 AS target_real", "1 AS predicao")
    for report in (
        evaluate.confusion_matrix(rows),
        evaluate.agreement_rate(rows),
        evaluate.prediction_profile(rows),
        evaluate.backlog(rows, rows, "id"),
    ):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "partial_" in plan and "Join" not in plan
