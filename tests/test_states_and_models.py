import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from retail_insight.operators import cohorts as coh
from retail_insight.operators.campaigns import enrich_with_playbook
from retail_insight.operators.clustering import perform_kmeans_clustering, pca_3d
from retail_insight.operators.features import compute_rfmt, customer_state, features_of_state, merge_customer_states
from retail_insight.operators.models import fit_customer_model
from retail_insight.operators.segments import playbook_table
from retail_insight.plans.catalog import _customers, order_transactions
from tests.conftest import SF_SMALL


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def tx(spark):
    return order_transactions(spark, SF_SMALL).cache()


def test_states_of_many_parts_merge_to_the_whole(tx):
    part = F.pmod(F.xxhash64("InvoiceNo", "TotalSpend"), F.lit(3))
    parts = [tx.where(part == k) for k in range(3)]
    states = [customer_state(p) for p in parts]
    merged = merge_customer_states(states[2], merge_customer_states(states[0], states[1]))
    assert _rows(features_of_state(merged)) == _rows(compute_rfmt(tx))
    assert _rows(features_of_state(customer_state(tx), "2030-01-01")) == _rows(compute_rfmt(tx, "2030-01-01"))
    cohorts = [coh.cohort_state(p) for p in parts]
    whole = coh.merge_cohort_states(cohorts[1], cohorts[2], cohorts[0], cohorts[1])     # one part twice
    assert _rows(coh.retention_of_state(whole)) == _rows(coh.cohort_retention(tx))


def test_late_lines_move_a_cohort(spark):
    def lines(*rows):
        return spark.createDataFrame(rows, "CustomerID string, d string").select("CustomerID", F.col("d").cast("timestamp_ntz").alias("PurchaseDate"))
    old = lines(("a", "2024-03-05"), ("b", "1969-12-31"), ("b", "2031-01-01"), (None, "2024-01-01"), ("c", None))
    new = lines(("a", "2023-12-01"), ("d", "2024-12-31"))
    merged = coh.retention_of_state(coh.merge_cohort_states(coh.cohort_state(old), coh.cohort_state(new)))
    assert _rows(merged) == _rows(coh.cohort_retention(old.union(new)))
    assert {(r.CohortMonth, r.CohortIndex) for r in merged.collect()} == {("2023-12", 0), ("2023-12", 3), ("1969-12", 0), ("1969-12", 733), ("2024-12", 0)}


def test_model_comes_back_from_files(spark, tmp_path):
    customers = _customers(spark, SF_SMALL).cache()
    model = fit_customer_model(customers, n_clusters=3)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    new = customers.where("CustomerID < '5'").drop("Monetary").withColumn("Monetary", F.lit(123.0))
    assert _rows(again.transform(new)) == _rows(model.transform(new))
    got = again.transform(customers)
    assert got.columns == [*customers.columns, "ML_Cluster", "PCA_1", "PCA_2", "PCA_3"]
    # the same as fitting and labelling in one go
    fitted, _, _ = perform_kmeans_clustering(customers, 3)
    scores, _ = pca_3d(customers)
    both = got.join(fitted.select("CustomerID", F.col("ML_Cluster").alias("c")), "CustomerID").join(
        scores.select("CustomerID", *[F.col(f"PCA_{i}").alias(f"p{i}") for i in (1, 2, 3)]), "CustomerID")
    off = both.where("c != ML_Cluster or abs(PCA_1 - p1) > 2e-4 or abs(PCA_2 - p2) > 2e-4 or abs(PCA_3 - p3) > 2e-4")
    assert both.count() == 150 and off.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_playbook_tables_are_checked(spark):
    customers = spark.createDataFrame([("1", "Champions"), ("2", "Unknown")], "CustomerID string, Segment string")
    book = playbook_table(spark)
    assert enrich_with_playbook(customers, book).count() == 2
    with pytest.raises(ValueError):
        enrich_with_playbook(customers, book.union(book))
