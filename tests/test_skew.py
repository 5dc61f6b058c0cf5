"""A customer holding a third of all lines: results stay exact and every
shuffle in the customer aggregate is fed by a map-side partial aggregate."""

import datetime as dt

import numpy as np
import pandas as pd

from retail_insight.operators.features import _customer_aggregate, compute_rfmt

TX_SCHEMA = ("CustomerID string, InvoiceNo string, PurchaseDate timestamp_ntz, TotalSpend double, "
             "Quantity double, UnitPrice double, Product string, ProductCategory string")


def _skewed_lines(n=6000, seed=4):
    rng = np.random.default_rng(seed)
    cust = rng.integers(0, 200, n).astype(str)
    cust[: n // 3] = "hot"
    inv = np.array([f"i{v}" for v in rng.integers(0, n // 2, n)])
    inv[: n // 6] = "giant"                                  # one invoice with a sixth of the lines
    day = rng.integers(0, 400, n)
    spend = np.round(rng.uniform(1, 100, n), 2)
    cats = rng.choice(["A", "B", "C"], n)
    base = dt.datetime(2023, 1, 1)
    rows = [(cust[i], inv[i], base + dt.timedelta(days=int(day[i]), hours=int(i % 24)), float(spend[i]),
             1.0, float(spend[i]), "p", str(cats[i])) for i in range(n)]
    return rows


def test_hot_customer_features_are_exact(spark):
    rows = _skewed_lines()
    tx = spark.createDataFrame(rows, TX_SCHEMA).repartition(6)
    got = {r.CustomerID: r for r in compute_rfmt(tx).collect()}
    pdf = pd.DataFrame(rows, columns=["c", "i", "d", "s", "q", "u", "p", "cat"])
    g = pdf.groupby("c").agg(first=("d", "min"), last=("d", "max"), freq=("i", "nunique"),
                             spend=("s", "sum"), lines=("i", "count"))
    snap = pdf["d"].max() + pd.Timedelta(days=1)
    top = (pdf.groupby(["c", "cat"])["s"].sum().reset_index()
           .sort_values(["c", "s"], ascending=[True, False]).drop_duplicates("c").set_index("c")["cat"])
    assert len(got) == len(g)
    for c, row in g.iterrows():
        r = got[c]
        assert r.Frequency == row.freq and r.TotalTransactions == row.lines
        assert r.Monetary == float(np.round(row.spend, 2))
        assert r.Recency == max((snap - row["last"]).days, 0)
        assert r.Tenure == max((snap - row["first"]).days, 1)
        assert r.TopCategory == top[c]


def test_every_shuffle_is_pre_aggregated(spark):
    tx = spark.createDataFrame(_skewed_lines(600), TX_SCHEMA)
    plan = _customer_aggregate(tx, "ProductCategory", "spend")._jdf.queryExecution().executedPlan().toString()
    lines = [ln.strip(" +-:") for ln in plan.splitlines()]
    exchanges = [i for i, ln in enumerate(lines) if ln.startswith("Exchange hashpartitioning")]
    assert len(exchanges) == 2
    for i in exchanges:
        below = lines[i + 1]
        assert "partial_" in below, below             # map-side combine feeds each shuffle
