import math

import pytest

from termloom.operators.evaluation import evaluate, gaps

RUN, QRELS, QUERIES = "query_id string, rank int, doc_id string", "query_id string, doc_id string, relevance int", "query_id string"


def metrics(spark, docs, grades, k=10, threshold=2):
    run = spark.createDataFrame([("q", i, d) for i, d in enumerate(docs, 1)], RUN)
    qrels = spark.createDataFrame([("q", d, g) for d, g in grades.items()], QRELS)
    rows, _ = evaluate(spark.createDataFrame([("q",)], QUERIES), run, qrels, k, threshold)
    return rows.first()


def test_perfect_run(spark):
    m = metrics(spark, ["d1", "d2", "d3"], {"d1": 3, "d2": 2, "d3": 1}, 3)
    assert (m.precision_at_k, m.recall_at_k, m.reciprocal_rank, m.ndcg_at_k) == (pytest.approx(2 / 3), 1.0, 1.0, pytest.approx(1.0))


def test_ndcg_value(spark):
    m = metrics(spark, ["d1", "d2", "d3"], {"d1": 3, "d2": 0, "d3": 2}, 3)
    assert m.ndcg_at_k == pytest.approx((3 + 2 / 2) / (3 + 2 / math.log2(3)))
    assert m.ndcg_at_k == pytest.approx(0.9386, abs=1e-4)


def test_precision_divides_by_k(spark):
    assert metrics(spark, ["d1"], {"d1": 3}, 10).precision_at_k == pytest.approx(0.1)


def test_unjudged_is_not_relevant(spark):
    m = metrics(spark, ["x", "d1"], {"d1": 2}, 2)
    assert (m.precision_at_k, m.reciprocal_rank) == (0.5, 0.5)


def test_nothing_relevant(spark):
    m = metrics(spark, ["d1"], {"d1": 0})
    assert (m.recall_at_k, m.reciprocal_rank, m.ndcg_at_k) == (1.0, 0.0, 0.0)


def test_reciprocal_rank_ignores_k(spark):
    """K23"""
    m = metrics(spark, ["a", "b", "c"], {"c": 3}, 1)
    assert (m.reciprocal_rank, m.recall_at_k) == (pytest.approx(1 / 3), 0.0)


def test_report_counts_all_queries(spark):
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",)], QUERIES)
    run = spark.createDataFrame([("q1", 1, "a")], RUN)
    qrels = spark.createDataFrame([("q1", "a", 3), ("q2", "b", 3)], QRELS)
    _, means = evaluate(queries, run, qrels, 1)
    row = means.first()
    assert row.num_queries == 3
    assert row.mean_precision_at_k == pytest.approx(1 / 3)
    assert row.mean_recall_at_k == pytest.approx((1 + 0 + 1) / 3)


def test_no_queries(spark):
    _, means = evaluate(spark.createDataFrame([], QUERIES), spark.createDataFrame([], RUN), spark.createDataFrame([], QRELS), 5)
    assert means.first().asDict() == {"mean_precision_at_k": 0.0, "mean_recall_at_k": 0.0, "mean_reciprocal_rank": 0.0, "mean_ndcg_at_k": 0.0, "k": 5, "num_queries": 0}


def test_bad_input(spark):
    """K21, K24"""
    queries, run = spark.createDataFrame([("q",)], QUERIES), spark.createDataFrame([("q", 1, "a")], RUN)
    with pytest.raises(ValueError, match="more than once"):
        evaluate(queries, run, spark.createDataFrame([("q", "a", 1), ("q", "a", 2)], QRELS))
    with pytest.raises(ValueError, match="k must"):
        evaluate(queries, run, spark.createDataFrame([("q", "a", 1)], QRELS), 0)


def test_gaps(spark):
    run = spark.createDataFrame([("q", 1, "a")], RUN)
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 2), ("q", "c", 1)], QRELS)
    docs = spark.createDataFrame([("b", "text of b")], "doc_id string, text string")
    assert [tuple(r) for r in gaps(qrels, run, docs).collect()] == [("q", "b", 2, "text of b")]
