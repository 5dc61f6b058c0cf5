"""Invariants over the driver tables (sf0.001)."""

from pyspark.sql import functions as F

from retail_insight.operators import cohorts as coh
from retail_insight.operators.clustering import perform_kmeans_clustering
from retail_insight.operators.segments import segment_kpi_summary
from retail_insight.plans.catalog import order_transactions
from retail_insight.plans.pipeline import customer_intelligence, customers_from_transactions
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_results_do_not_depend_on_partitioning(spark):
    tx = order_transactions(spark, SF_SMALL)
    a = customers_from_transactions(tx.repartition(3))
    b = customers_from_transactions(tx.repartition(7, "InvoiceNo"))
    assert _rows(a) == _rows(b)


def test_segment_and_value_invariants(spark):
    valued = customer_intelligence(order_transactions(spark, SF_SMALL))
    n = valued.count()
    assert valued.select("CustomerID").distinct().count() == n           # one row, one segment each
    summary = segment_kpi_summary(valued).collect()
    assert sum(r.CustomerCount for r in summary) == n
    total = valued.agg(F.sum(F.rint(F.col("Monetary") * 100).cast("bigint"))).first()[0]
    assert sum(round(r.TotalRevenue * 100) for r in summary) == total
    lo, hi = valued.agg(F.min("P_Alive"), F.max("P_Alive")).first()
    assert 0.02 <= lo <= hi <= 0.99
    for s in ("R_Score", "F_Score", "M_Score", "T_Score"):
        sizes = [r["count"] for r in valued.groupBy(s).count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1            # equal-frequency bins


def test_cohort_invariants(spark):
    tx = order_transactions(spark, SF_SMALL, with_product=False)
    ret = coh.cohort_retention(tx)
    assert {r.RetentionPct for r in ret.where("CohortIndex = 0").collect()} == {100.0}
    sizes = coh.cohort_sizes(tx).agg(F.sum("CohortSize")).first()[0]
    assert sizes == tx.select("CustomerID").distinct().count()
    assert ret.where((F.col("RetentionPct") < 0) | (F.col("RetentionPct") > 100)).count() == 0


def test_cluster_counts_cover_every_customer(spark):
    customers = customers_from_transactions(order_transactions(spark, SF_SMALL))
    clustered, model, profile = perform_kmeans_clustering(customers, n_clusters=3, n_init=3)
    assert sum(r.CustomerCount for r in profile.collect()) == customers.count()
    assert clustered.select("ML_Cluster").distinct().count() == 3 and len(model.clusterCenters()) == 3
