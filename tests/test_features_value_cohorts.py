import datetime as dt

import numpy as np

from retail_insight.operators import cohorts as coh
from retail_insight.operators.features import compute_rfm_legacy, compute_rfmt
from retail_insight.operators.value import churn_watchlist, estimate_value

TX_SCHEMA = ("CustomerID string, InvoiceNo string, PurchaseDate timestamp_ntz, TotalSpend double, "
             "Quantity double, UnitPrice double, Product string, ProductCategory string")


def _tx(spark, rows):
    return spark.createDataFrame(rows, TX_SCHEMA)


def test_features_floor_days_clips_and_ties(spark):
    d = dt.datetime
    rows = [("a", "1", d(2024, 1, 1, 23, 0), 10.0, 1.0, 10.0, "p", "Toys"),
            ("a", "1", d(2024, 1, 1, 23, 0), 5.0, 2.0, 2.5, "q", "Books"),
            ("a", "2", d(2024, 1, 3, 12, 0), 5.0, 1.0, 5.0, "q", "Books"),    # Books 10 = Toys 10 -> Books
            ("b", "3", d(2024, 1, 4, 23, 59), 0.125, 1.0, 0.125, "p", "Toys")]
    out = {r.CustomerID: r for r in compute_rfmt(_tx(spark, rows)).collect()}
    # snapshot = 2024-01-05 23:59
    a, b = out["a"], out["b"]
    assert (a.Frequency, a.Monetary, a.TotalTransactions, a.TotalItems) == (2, 20.0, 3, 4.0)
    assert (a.Recency, a.Tenure) == (2, 4)             # 59h59m -> 2 ; 96h59m -> 4
    assert a.AvgOrderValue == 10.0 and a.TopCategory == "Books"
    assert (b.Recency, b.Tenure, b.Monetary) == (1, 1, 0.12)   # tenure clipped at 1; 0.125 -> 0.12
    later = {r.CustomerID: r for r in compute_rfmt(_tx(spark, rows), snapshot_date="2024-01-02").collect()}
    assert later["b"].Recency == 0 and later["b"].Tenure == 1     # negative spans clipped
    legacy = {r.CustomerID: r for r in compute_rfm_legacy(_tx(spark, rows)).collect()}
    assert legacy["a"].FavoriteProduct == "q" and "Tenure" not in legacy["a"].asDict()


def _p_alive(r, f, t):
    lam = (f + 1.2) / (t + 60.0)
    cad = max(t / max(f, 1.0), 7.0)
    h = 1.4 * (r / cad - 1.8) + 1.2 * (r / max(t, 1.0) - 0.4)
    p = 1.0 / (1.0 + np.exp(np.clip(h, -10, 10)))
    return float(np.clip(p, 0.02, 0.99)), lam


def test_value_formula_and_tiers(spark):
    rows = [("a", 3, 10, 400, 100.0, 50.0), ("b", 300, 1, 310, 20.0, 20.0), ("c", 40, 4, 200, 80.0, 20.0),
            ("d", 0, 1, 1, 10.0, 10.0)]
    df = spark.createDataFrame(rows, "CustomerID string, Recency int, Frequency long, Tenure int, "
                                     "Monetary double, AvgOrderValue double")
    out = {r.CustomerID: r for r in estimate_value(df, 90, 0.35).collect()}
    for cid, r_, f_, t_, _m, aov in rows:
        p, lam = _p_alive(float(r_), float(f_), float(t_))
        o = out[cid]
        assert o.P_Alive == float(np.round(p, 4))
        assert o.P_Alive_Pct == float(np.round(p * 100, 1))
        assert o.Churn_Risk_Pct == float(np.round((1 - p) * 100, 1))
        assert o.Expected_Orders_90d == float(np.round(p * lam * 90, 2))
        assert o.Predicted_Spend_90d == float(np.round(p * lam * 90 * aov, 2))
        assert o.Predictive_CLV_90d == float(np.round(p * lam * 90 * aov * 0.35, 2))
        tier = ("🟢 Low Churn Risk" if o.P_Alive >= 0.75 else
                "🟡 Moderate Watch" if o.P_Alive >= 0.45 else "🔴 High Churn Risk")
        assert o.Churn_Risk_Tier == tier


def test_watchlist_median_is_inclusive(spark):
    rows = [(str(i), float(m), p) for i, (m, p) in enumerate([(10, 0.1), (20, 0.2), (30, 0.3), (40, 0.9)])]
    df = spark.createDataFrame(rows, "CustomerID string, Monetary double, P_Alive double")
    got = [r.CustomerID for r in churn_watchlist(df).collect()]
    assert got == ["2"]                                   # median 25: 30 qualifies, 40 is alive
    rows.append(("9", 25.0, 0.2))                         # odd n, median exactly 25 -> kept (>=)
    df = spark.createDataFrame(rows, "CustomerID string, Monetary double, P_Alive double")
    assert [r.CustomerID for r in churn_watchlist(df).collect()] == ["2", "9"]


def test_cohorts_skip_absent_cells_and_cut_observed_columns(spark):
    d = dt.datetime
    rows = []
    # cohort 2024-01: 2 customers; months 0, 1 and 3 observed (2 is skipped everywhere)
    for cid, months in (("a", [1, 2, 4]), ("b", [1, 4])):
        for m in months:
            rows.append((cid, f"{cid}{m}", d(2024, m, 5), 1.0, 1.0, 1.0, "p", "c"))
    # cohort 2024-03: 1 customer, months 0 and 1
    rows += [("c", "c3", d(2024, 3, 9), 1.0, 1.0, 1.0, "p", "c"), ("c", "c4", d(2024, 4, 9), 1.0, 1.0, 1.0, "p", "c")]
    ret = coh.first_month_columns(coh.cohort_retention(_tx(spark, rows)), 2)
    cells = {(r.CohortMonth, r.CohortIndex): (r.ActiveCustomers, r.CohortSize, r.RetentionPct) for r in ret.collect()}
    assert cells == {("2024-01", 0): (2, 2, 100.0), ("2024-01", 1): (1, 2, 50.0), ("2024-03", 0): (1, 1, 100.0),
                     ("2024-03", 1): (1, 1, 100.0)}
    full = coh.cohort_retention(_tx(spark, rows))
    assert {(r.CohortMonth, r.CohortIndex) for r in full.collect()} >= {("2024-01", 3)}
    curve = {r.CohortIndex: r.AvgRetentionPct for r in coh.average_retention_curve(full).collect()}
    assert curve == {0: 100.0, 1: 75.0, 3: 100.0}          # absent cells are skipped, not zero
    bench = coh.retention_benchmarks(full).first()
    assert (bench.Month1RetentionPct, bench.Month3RetentionPct, bench.Month6RetentionPct) == (75.0, 100.0, 0.0)
    wide = coh.cohort_matrix(full).orderBy("CohortMonth").collect()
    assert wide[0].Month_0 == 100.0 and wide[1].Month_3 is None
