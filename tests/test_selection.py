import random

import pytest
from pyspark.sql import functions as F

from retail_insight.operators import selection
from retail_insight.operators.scoring import calculate_rfmt_scores, rank_quantile, scores_by_id
from retail_insight.operators.selection import order_statistics


def _rows(seed, n, long_ids=False):
    rng = random.Random(seed)
    ids = [("customer-number-" if long_ids else "") + str(i) for i in range(n)]
    rng.shuffle(ids)
    out = []
    for k, i in enumerate(ids):
        v = 1.0 if k < n // 3 else rng.choice([rng.uniform(-50, 50), rng.randint(0, 5), 7.25])   # a third share a value
        out.append((i, None if k % 97 == 5 else float(v), rng.randint(0, 3)))
    return out


def _sorted(rows, column, ascending):
    def key(r):
        v = r[column]
        v = float("-inf" if ascending else "inf") if v is None else (v if ascending else -v)
        return v, r[0].encode()
    return sorted(rows, key=key)


@pytest.mark.parametrize("enough, accuracy, long_ids", [(2000, 10_000, False), (40, 100, False), (5, 20, True)])
def test_order_statistics_equal_a_sort(spark, monkeypatch, enough, accuracy, long_ids):
    monkeypatch.setattr(selection, "ENOUGH", enough)
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    rows = _rows(4, 700, long_ids)
    df = spark.createDataFrame(rows, "id string, v double, w int").repartition(5).cache()
    ranks = [1, 2, 233, 350, 351, 699, 700]
    n, found = order_statistics(df, [(F.col("v"), True), (F.col("v"), False), (F.col("w"), False)], "id", lambda n: ranks)
    assert n == 700
    for got, (column, asc) in zip(found, ((1, True), (1, False), (2, False)), strict=True):
        order = _sorted(rows, column, asc)
        assert [(r["id"], r["value"]) for r in got] == [(order[k - 1][0], order[k - 1][column]) for k in ranks]


def test_equal_ids_end_the_search(spark, monkeypatch):
    monkeypatch.setattr(selection, "ENOUGH", 3)
    df = spark.createDataFrame([("same", 1.0)] * 50 + [("z", 2.0)], "id string, v double")
    _, found = order_statistics(df, [(F.col("v"), True)], "id", lambda n: [10, 51])
    assert [r["id"] for r in found[0]] == ["same", "z"]


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, v double")
    assert order_statistics(df, [(F.col("v"), True)], "id", lambda n: [1, 2, 3])[1][0][2] is None
    assert order_statistics(df.where("1 = 0"), [(F.col("v"), True)], "id", lambda n: [1]) == (0, [[None]])


@pytest.mark.parametrize("enough", [2000, 30])
def test_scores_equal_explicit_ranks(spark, monkeypatch, enough):
    monkeypatch.setattr(selection, "ENOUGH", enough)
    rows = [(i, v or 0.0, w) for i, v, w in _rows(9, 401)]
    df = spark.createDataFrame(rows, "CustomerID string, v double, w int").cache()
    for q in (4, 5):
        got = {r["CustomerID"]: (r["a"], r["b"]) for r in scores_by_id(df, (("v", False, "a"), ("w", True, "b")), q, "CustomerID").collect()}
        a = {r["CustomerID"]: r["a"] for r in rank_quantile(df, "v", False, "a", q).collect()}
        b = {r["CustomerID"]: r["b"] for r in rank_quantile(df, "w", True, "b", q).collect()}
        assert got == {i: (a[i], b[i]) for i in a}


def test_scoring_neither_sorts_nor_shuffles(spark):
    df = spark.range(5000).selectExpr("cast(id as string) as CustomerID", "id % 91 as Recency", "id % 7 as Frequency",
                                      "id * 1.5 as Monetary", "id % 13 as Tenure")
    plan = calculate_rfmt_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Join" not in plan
