"""Composed pipelines: raw lines -> customer table -> value -> action plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from retail_insight.operators.campaigns import action_plan, enrich_with_playbook
from retail_insight.operators.clustering import (
    PCA_COLUMNS,
    RFMT_FEATURES,
    add_pca,
    cluster_zscored,
    evaluate_kmeans_candidates,
    optimal_k,
    zscore_features,
)
from retail_insight.session import materialize
from retail_insight.operators.features import compute_rfm_legacy, compute_rfmt
from retail_insight.operators.ingest import standardize_transactions, standardize_transactions_legacy
from retail_insight.operators.scoring import calculate_rfm_scores_legacy, calculate_rfmt_scores
from retail_insight.operators.segments import assign_segments
from retail_insight.operators.value import estimate_value


def customers_from_transactions(clean_tx: DataFrame, snapshot_date=None) -> DataFrame:
    """Features -> scores -> segment (+ icon, colour)."""
    features = compute_rfmt(clean_tx, snapshot_date)
    if snapshot_date is not None:   # else they already rest on files
        features = materialize(features)
    return assign_segments(calculate_rfmt_scores(features))


def process_rfmt_pipeline(raw: DataFrame, snapshot_date=None,
                          custom_mapping: Mapping[str, str] | None = None,
                          date_layout: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean transactions, scored and segmented customers)."""
    clean = standardize_transactions(raw, custom_mapping, date_layout)
    return clean, customers_from_transactions(clean, snapshot_date)


def process_rfm_legacy_pipeline(raw: DataFrame, snapshot_date=None) -> tuple[DataFrame, DataFrame]:
    """Five-segment variant: (clean transactions, customers with 1..4 scores)."""
    clean = standardize_transactions_legacy(raw)
    features = compute_rfm_legacy(clean, snapshot_date)
    if snapshot_date is not None:
        features = materialize(features)
    customers = calculate_rfm_scores_legacy(features)
    return clean, assign_segments(customers, taxonomy="five")


def customer_intelligence(clean_tx: DataFrame, snapshot_date=None, horizon_days: int = 90,
                          gross_margin: float = 0.35) -> DataFrame:
    """Segmented customers with P(alive), churn tier and forecasts."""
    return estimate_value(customers_from_transactions(clean_tx, snapshot_date), horizon_days, gross_margin)


def build_action_plan(valued: DataFrame, n_clusters: int | None = None, playbooks: DataFrame | None = None,
                      min_k: int = 2, max_k: int = 7) -> tuple[DataFrame, DataFrame, list[float]]:
    """Cluster, project and enrich the customer table into the 34-column
    plan. k is chosen by the best silhouette on the 3-D PCA coordinates
    unless ``n_clusters`` is given; clusters are fitted on the 4-D
    z-scores. The z-scores and the PCA fit are computed once and the
    customer table is materialised once for all model passes. Returns
    (plan, k evaluation, explained variance %)."""
    zcols = [f"z_{c}" for c in RFMT_FEATURES]
    z = materialize(zscore_features(valued))
    projected, evr = add_pca(z)
    projected = materialize(projected)
    evaluation = evaluate_kmeans_candidates(projected, list(PCA_COLUMNS), "CustomerID", min_k, max_k)
    k = n_clusters or optimal_k(evaluation)
    clustered, _model = cluster_zscored(projected, k)
    plan = action_plan(enrich_with_playbook(clustered.drop(*zcols), playbooks))
    return plan, evaluation, evr
