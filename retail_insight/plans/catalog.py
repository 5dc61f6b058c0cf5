"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over the
driver tables and runs the library's operators on whole tables.

Source A is order lines (``lineitem JOIN orders JOIN part``), source B is
``events``. Stand-in raw inputs for the ingest operators are built here by
renaming/retyping table columns and, for the dirty-input queries, by
injecting malformed values with a fixed rule; the operators do all the
cleaning.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_insight.functions.numeric import half_even, money_sum
from retail_insight.operators import campaigns as camp
from retail_insight.operators import clustering as ml
from retail_insight.operators import cohorts as coh
from retail_insight.operators.features import compute_rfmt, customer_state, features_of_state, merge_customer_states, snapshot_next_midnight
from retail_insight.operators.ingest import (
    clean_online_retail,
    clean_online_retail_counted,
    picker_mapping,
    retail_cleaning_profile,
    standardize_transactions,
    transactions_profile,
    with_invoice_numbers,
)
from retail_insight.operators.models import fit_customer_model
from retail_insight.operators.segments import legacy_playbook_table, segment_kpi_summary
from retail_insight.operators.value import churn_watchlist, growth_targets
from retail_insight.plans.pipeline import (
    build_action_plan,
    customer_intelligence,
    customers_from_transactions,
    process_rfm_legacy_pipeline,
)
from retail_insight.session import ensure_checkpoint_dir, materialize
from retail_insight.sources.files import read_records
from retail_insight.sources.sinks import read_export, write_csv, write_parquet
from retail_insight.sources.tables import (
    events_as_raw_transactions,
    orders_as_raw_transactions,
    read_table,
)

# ---------------------------------------------------------------- inputs


def order_transactions(spark: SparkSession, sf_dir: str, with_product: bool = True) -> DataFrame:
    return standardize_transactions(orders_as_raw_transactions(spark, sf_dir, with_product))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize_transactions(events_as_raw_transactions(spark, sf_dir))


def _lines(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    o = read_table(spark, sf_dir, "orders")
    p = read_table(spark, sf_dir, "part")
    return (li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey))


def dirty_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as an all-text export with alias headers and malformed
    values: missing / padded / 'nan' customers, unparsable dates and
    amounts, missing and zero quantities, negative amounts."""
    k = F.col("l_orderkey")
    ln = F.col("l_linenumber")
    cust = F.col("o_custkey").cast("string")
    spend = half_even(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), 2)
    return _lines(spark, sf_dir).select(
        F.when(k % 17 == 0, F.lit(None).cast("string"))
         .when(k % 23 == 0, F.lit("nan"))
         .when(ln == 2, F.concat(F.lit("  "), cust, F.lit(" ")))
         .otherwise(cust).alias("Client-ID"),
        F.col("o_orderkey").cast("string").alias("Invoice"),
        F.when(k % 19 == 0, F.lit("not a date"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("order_date"),
        F.when(k % 29 == 0, F.lit("n/a"))
         .when(ln == 7, (-spend).cast("string"))
         .otherwise(spend.cast("string")).alias("Amount"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
         .when(k % 31 == 0, F.lit("0"))
         .otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("Quantity"),
        F.col("p_type").alias("Dept"),
        F.col("p_name").alias("Item"),
    )


def mapped_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with names no alias list knows (needs an explicit map)."""
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("acct"),
        F.col("o_orderdate").alias("booked_at"),
        F.col("l_extendedprice").alias("gross"),
        F.col("o_orderkey").alias("doc"),
        F.col("p_brand").alias("line_group"),
    )


def picker_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under headers that only the keyword picker resolves
    (by substring: client -> customer, time -> date, price -> spend,
    dept -> category), plus an exact ``Order_ID`` and an unmapped ``Qty``."""
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("Client Name"),
        F.col("o_orderdate").alias("Order Time"),
        F.col("l_extendedprice").alias("Sale Price"),
        F.col("l_orderkey").alias("Order_ID"),
        F.col("p_brand").alias("Product Dept"),
        F.col("l_quantity").alias("Qty"),
    )


def unpriced_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with quantity and unit price but no spend column."""
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("CustomerID"),
        F.col("o_orderkey").alias("InvoiceNo"),
        F.col("o_orderdate").alias("PurchaseDate"),
        F.col("l_quantity").alias("Quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("UnitPrice"),
        F.col("p_type").alias("ProductCategory"),
    )


def uninvoiced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without an event id: every line becomes its own invoice."""
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user_id"), F.col("ts").alias("timestamp"), F.col("value").alias("amount"))


def _spend():
    return half_even(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), 2)


def account_lines(spark: SparkSession, sf_dir: str, account) -> DataFrame:
    """Order lines under canonical names, booked on ``account``."""
    return _lines(spark, sf_dir).select(
        account.alias("CustomerID"), F.col("o_orderkey").alias("InvoiceNo"), F.col("o_orderdate").alias("PurchaseDate"),
        _spend().alias("TotalSpend"), F.col("l_quantity").alias("Quantity"), F.col("p_type").alias("ProductCategory"))


def legacy_alias_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines booked on their day, under aliases of the five-segment
    variant, some without a spend."""
    return _lines(spark, sf_dir).select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Customer No"), F.col("o_orderkey").alias("Invoice Number"),
        F.col("o_orderdate").alias("order_date"), F.col("p_name").alias("Item"), F.col("l_quantity").alias("Qty"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("Item Price"),
        F.when(F.col("l_linenumber") == 3, F.lit(None).cast("double")).otherwise(_spend()).alias("Sales"))


def gap_lines(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """Order lines, some without an invoice or a category, under ``names``."""
    cols = (F.col("o_custkey"), F.when(F.col("l_orderkey") % 7 != 0, F.col("o_orderkey").cast("string")), F.col("o_orderdate"),
            _spend(), F.when(F.col("l_linenumber") != 2, F.col("p_type")))
    return _lines(spark, sf_dir).select(*[c.alias(n) for c, n in zip(cols, names, strict=True)])


def dated_lines(spark: SparkSession, sf_dir: str, last_day: int = 31) -> DataFrame:
    """Order lines with dates as ``dd/MM/yyyy`` text, some of them ISO or no
    date; days after ``last_day`` count as that day."""
    k, d = F.col("l_orderkey"), F.col("o_orderdate")
    day = F.make_date(F.year(d), F.month(d), F.least(F.dayofmonth(d), F.lit(last_day)))
    return _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("invoice"),
        F.when(k % 19 == 0, F.lit("soon")).when(k % 23 == 0, F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "dd/MM/yyyy")).alias("date"),
        _spend().alias("sales"), F.col("p_type").alias("category"))


CSV_HEADER = ("customer", "invoice", "date", "sales", "category")


def csv_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, bad) of CSV files made of the order lines: categories with
    quotes, separators and line breaks in them, and some records with a field
    too many."""
    category = F.concat(F.col("p_type"), F.when(F.col("l_linenumber") == 2, F.concat(F.lit(' "'), F.col("p_brand"), F.lit('",\nas seen')))
                        .otherwise(F.lit("")))
    rows = _lines(spark, sf_dir).select(
        F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("invoice"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        _spend().alias("sales"), category.alias("category"), (F.col("l_orderkey") % 37 == 0).alias("wide"))
    folder = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    good, wide = rows.where("not wide").drop("wide"), rows.where("wide").withColumn("wide", F.lit("one more"))
    for name, some in (("good", good), ("wide", wide)):
        some.write.options(header=True, escape='"').csv(f"{folder}/{name}")
    return read_records(spark, [f"{folder}/good", f"{folder}/wide"], columns=CSV_HEADER)


CUSTOM_MAPPING = {"CustomerID": "acct", "PurchaseDate": "booked_at", "TotalSpend": "gross",
                  "InvoiceNo": "doc", "ProductCategory": "line_group"}


def online_retail_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the online-retail export layout: returned lines are
    cancellations (``C`` invoice, negative quantity), customers with a
    negative balance have no id, dates are ``M/d/yyyy H:mm`` text."""
    c = read_table(spark, sf_dir, "customer")
    n = read_table(spark, sf_dir, "nation")
    lines = (_lines(spark, sf_dir).join(c, F.col("o_custkey") == F.col("c_custkey"))
             .join(n, F.col("c_nationkey") == F.col("n_nationkey")))
    ret = F.col("l_returnflag") == "R"
    qty = F.col("l_quantity").cast("bigint")
    return lines.select(
        F.when(ret, F.concat(F.lit("C"), F.col("o_orderkey").cast("string")))
         .otherwise(F.col("o_orderkey").cast("string")).alias("InvoiceNo"),
        F.when(F.col("l_linenumber") == 3, F.lit(None).cast("string"))
         .otherwise(F.concat(F.col("p_name"), F.lit(" "))).alias("Description"),
        F.when(ret, -qty).otherwise(qty).cast("string").alias("Quantity"),
        F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("InvoiceDate"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).cast("string").alias("UnitPrice"),
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_custkey").cast("double")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
    )


# ---------------------------------------------------------------- shared


def _customers(spark, sf_dir):
    return customers_from_transactions(order_transactions(spark, sf_dir))


def _valued(spark, sf_dir):
    return customer_intelligence(order_transactions(spark, sf_dir))


def _retention(spark, sf_dir):
    return coh.first_month_columns(coh.cohort_retention(order_transactions(spark, sf_dir, with_product=False)))


# ---------------------------------------------------------------- queries


def q_customer_features(spark, sf_dir):
    """Snapshot, per-customer aggregates, recency/tenure, top category."""
    return compute_rfmt(order_transactions(spark, sf_dir))


def q_customer_features_events(spark, sf_dir):
    """F1-F7 on events (time of day present: whole 24 h spans, not dates)."""
    return compute_rfmt(event_transactions(spark, sf_dir))


def q_customer_features_dashboard_snapshot(spark, sf_dir):
    """F1A: snapshot = midnight after the latest raw date (events keep time of day)."""
    raw = events_as_raw_transactions(spark, sf_dir)
    return compute_rfmt(standardize_transactions(raw), snapshot_next_midnight(raw, "PurchaseDate"))


def q_customer_segments(spark, sf_dir):
    """Quintile scores, RFM string, mean, segment, icon, colour."""
    return _customers(spark, sf_dir)


def q_customer_segments_events(spark, sf_dir):
    return customers_from_transactions(event_transactions(spark, sf_dir))


def q_segment_summary(spark, sf_dir):
    """KPIs for all seven segments."""
    return segment_kpi_summary(_customers(spark, sf_dir))


def q_segment_summary_events(spark, sf_dir):
    return segment_kpi_summary(customers_from_transactions(event_transactions(spark, sf_dir)))


def q_customer_value(spark, sf_dir):
    """V1-V9: P(alive), churn tier, 90-day forecasts."""
    return _valued(spark, sf_dir)


def q_customer_value_params(spark, sf_dir):
    """30-day horizon, 50 % margin (names keep the _90d suffix)."""
    return customer_intelligence(event_transactions(spark, sf_dir), horizon_days=30, gross_margin=0.5)


def q_churn_watchlist(spark, sf_dir):
    """Below 0.45 alive and at or above median spend."""
    return churn_watchlist(_valued(spark, sf_dir))


def q_churn_watchlist_top_quartile(spark, sf_dir):
    """Same with the 75th percentile of spend."""
    return churn_watchlist(_valued(spark, sf_dir), spend_quantile=0.75)


def q_growth_targets(spark, sf_dir):
    """Top 10 by forecast spend."""
    return growth_targets(_valued(spark, sf_dir))


def q_cohort_retention(spark, sf_dir):
    """H1-H8: the whole retention triangle."""
    return coh.cohort_retention(order_transactions(spark, sf_dir, with_product=False))


def q_cohort_sizes(spark, sf_dir):
    """H7: customers per acquisition month."""
    return coh.cohort_sizes(order_transactions(spark, sf_dir, with_product=False))


def q_cohort_matrix(spark, sf_dir):
    """H6: wide retention matrix."""
    return coh.cohort_matrix(_retention(spark, sf_dir))


def q_cohort_heatmap(spark, sf_dir):
    """Heatmap cell feed."""
    return coh.heatmap_cells(_retention(spark, sf_dir))


def q_cohort_curve(spark, sf_dir):
    """Average retention per month index."""
    return coh.average_retention_curve(_retention(spark, sf_dir))


def q_cohort_benchmarks(spark, sf_dir):
    """Month 1/3/6 mean retention."""
    return coh.retention_benchmarks(_retention(spark, sf_dir))


def q_cohort_retention_events(spark, sf_dir):
    return coh.cohort_retention(event_transactions(spark, sf_dir))


def q_global_kpis(spark, sf_dir):
    """R1."""
    return camp.global_kpis(_valued(spark, sf_dir))


def q_churn_tiers(spark, sf_dir):
    """R2."""
    return camp.churn_tier_counts(_valued(spark, sf_dir))


def q_churn_tiers_events(spark, sf_dir):
    """R2 where some tiers are absent (0 rows)."""
    return camp.churn_tier_counts(customer_intelligence(event_transactions(spark, sf_dir)))


def q_p_alive_histogram(spark, sf_dir):
    """R3."""
    return camp.p_alive_histogram(_valued(spark, sf_dir))


def q_revenue_rollup(spark, sf_dir):
    """R4."""
    return camp.revenue_rollup(_customers(spark, sf_dir))


def q_revenue_share(spark, sf_dir):
    """R5 / D6."""
    return camp.revenue_share(segment_kpi_summary(_customers(spark, sf_dir)))


def q_value_scatter(spark, sf_dir):
    """R6."""
    return camp.value_scatter(_valued(spark, sf_dir))


def q_watchlist_display(spark, sf_dir):
    """R7."""
    return camp.watchlist_display(churn_watchlist(_valued(spark, sf_dir)))


def q_campaign_roi(spark, sf_dir):
    """Default campaign inputs, every segment."""
    return camp.campaign_roi(_valued(spark, sf_dir))


def q_roi_grid(spark, sf_dir):
    """R8S: reach x conversion grid at default budget and margin."""
    return camp.roi_grid(_valued(spark, sf_dir), budget=(3500, 3500, 500), margin=(40, 40, 5))


def q_campaign_audience(spark, sf_dir):
    """First 80 % of each segment in customer-id order."""
    return camp.campaign_audience(_valued(spark, sf_dir)).select(
        "Segment", "CustomerID", "AudienceRank", "Monetary", "AvgOrderValue")


def q_segment_summary_display(spark, sf_dir):
    """R10."""
    return camp.segment_summary_display(segment_kpi_summary(_customers(spark, sf_dir)))


def q_action_plan_core(spark, sf_dir):
    """R11-R12 without the model columns (cluster, PCA)."""
    cols = [c for c in camp.ACTION_PLAN_COLUMNS if c not in ("ML_Cluster", "PCA_1", "PCA_2", "PCA_3")]
    return camp.action_plan(camp.enrich_with_playbook(_valued(spark, sf_dir)), cols)


def q_legacy_rfm(spark, sf_dir):
    """C3, G3, G4 (five segments), F7L, I2L, I8L."""
    raw = orders_as_raw_transactions(spark, sf_dir)
    _, customers = process_rfm_legacy_pipeline(raw)
    return customers


def q_legacy_segment_summary(spark, sf_dir):
    """G7."""
    _, customers = process_rfm_legacy_pipeline(orders_as_raw_transactions(spark, sf_dir))
    return segment_kpi_summary(customers, taxonomy="five")


def q_ingest_dirty(spark, sf_dir):
    """Alias headers, text values, malformed rows dropped."""
    return standardize_transactions(dirty_raw_lines(spark, sf_dir))


def q_ingest_custom_mapping(spark, sf_dir):
    """Explicit mapping; quantity and price defaults."""
    return standardize_transactions(mapped_raw_lines(spark, sf_dir), CUSTOM_MAPPING)


def q_ingest_keyword_picker(spark, sf_dir):
    """I3 -> I1: keyword picker chooses the mapping, then standardise."""
    raw = picker_raw_lines(spark, sf_dir)
    return standardize_transactions(raw, picker_mapping(raw.columns))


def q_ingest_spend_from_price(spark, sf_dir):
    """I8: spend = quantity x unit price at 2 dp when there is no spend column."""
    return standardize_transactions(unpriced_raw_lines(spark, sf_dir))


def q_customer_features_no_invoice(spark, sf_dir):
    """I4: generated one-line invoices (Frequency = lines)."""
    return compute_rfmt(standardize_transactions(uninvoiced_events(spark, sf_dir)))


def q_dirty_segments(spark, sf_dir):
    """Full customer pipeline on the dirty export."""
    return customers_from_transactions(standardize_transactions(dirty_raw_lines(spark, sf_dir)))


def q_retail_clean(spark, sf_dir):
    """I13 / K5 content: online-retail cleaning, sorted by date."""
    return clean_online_retail(online_retail_raw(spark, sf_dir)).orderBy("PurchaseDate", "InvoiceNo")


def q_retail_profile(spark, sf_dir):
    """Counts through the cleaning steps."""
    return retail_cleaning_profile(online_retail_raw(spark, sf_dir))


def q_transactions_profile(spark, sf_dir):
    """I14 on canonical lines."""
    return transactions_profile(order_transactions(spark, sf_dir, with_product=False))


def q_zscore_features(spark, sf_dir):
    """M1-M2: log1p + population z-scores (6 dp)."""
    z = ml.zscore_features(compute_rfmt(order_transactions(spark, sf_dir)))
    zc = [f"z_{c}" for c in ml.RFMT_FEATURES]
    return z.select("CustomerID", *[F.rint(F.col(c) * F.lit(1e6)).cast("bigint").alias(c) for c in zc])


def q_silhouette_embeddings(spark, sf_dir):
    """M5 with fixed labels: silhouette (squared distances, all rows) of ``embeddings.label``."""
    emb = read_table(spark, sf_dir, "embeddings")
    sil = ml.embedding_silhouette(emb, "embedding", "label")
    return sil.select("key", F.rint(F.col("silhouette") * F.lit(1e4)).cast("bigint").alias("silhouette_e4"))


def q_feature_correlations(spark, sf_dir):
    """Pairwise Pearson correlations of R, F, M, T."""
    return camp.feature_correlations(_customers(spark, sf_dir))


def q_watchlist_top3(spark, sf_dir):
    """Console digest, three highest-spend watchlist accounts."""
    return churn_watchlist(_valued(spark, sf_dir)).limit(3).select(
        "CustomerID", "Monetary", "Recency", "P_Alive_Pct")


def q_feature_scatter(spark, sf_dir):
    """R/F/M/T scatter-matrix feed."""
    return camp.feature_scatter(_customers(spark, sf_dir))


def q_customer_lookup(spark, sf_dir):
    """D3: one customer's full row (the customer with the largest spend)."""
    customers = materialize(_customers(spark, sf_dir))
    top_id = customers.orderBy(F.col("Monetary").desc(), F.col("CustomerID")).select("CustomerID").first()[0]
    return camp.customer_lookup(customers, top_id)


def q_segment_browser(spark, sf_dir):
    """D3: filter to two segments, sort by spend."""
    return camp.filter_and_sort(_customers(spark, sf_dir), ["Champions", "At-Risk VIPs"]).select(
        "CustomerID", "Segment", "Monetary", "Recency", "Frequency")


def q_kmeans_sweep(spark, sf_dir):
    """Inertia and silhouette for k = 2..7 on PCA coordinates."""
    projected, _ = ml.pca_3d(_customers(spark, sf_dir))
    return ml.evaluate_kmeans_candidates(projected, list(ml.PCA_COLUMNS))


def q_customer_clusters(spark, sf_dir):
    """M3, M7, M8: k = 4 clusters on z-scores and their profile."""
    _, _, profile = ml.perform_kmeans_clustering(_customers(spark, sf_dir), n_clusters=4)
    return profile


def q_pca_projection(spark, sf_dir):
    """PCA coordinates (variance ratios in every row)."""
    projected, evr = ml.add_pca(materialize(ml.zscore_features(_customers(spark, sf_dir))))
    clustered, _ = ml.cluster_zscored(materialize(projected), 4)
    return clustered.select("CustomerID", "Segment", "ML_Cluster", "PCA_1", "PCA_2", "PCA_3", "Recency", "Frequency",
                            "Monetary", "Tenure").withColumns(
        {f"EVR_{i + 1}": F.lit(v) for i, v in enumerate(evr)})


def q_cluster_profile_by_segment(spark, sf_dir):
    """M8 with fixed labels: the segments take the clusters' place."""
    return ml.cluster_profile(_customers(spark, sf_dir), "Segment")


def q_cluster_invariants(spark, sf_dir):
    """M3: every customer at its nearest center, distances adding up."""
    z = materialize(ml.zscore_features(_customers(spark, sf_dir)))
    _, model = ml.cluster_zscored(z, 4)
    return ml.cluster_check(z, model)


def q_pca_invariants(spark, sf_dir):
    """M9: all four components together keep the z-scores' variance, and no
    two correlate."""
    z = materialize(ml.zscore_features(_customers(spark, sf_dir)))
    p, _ = ml.add_pca(z, n_components=4)
    pairs = [(a, b) for a in range(1, 5) for b in range(a + 1, 5)]
    total = sum((F.var_pop(f"PCA_{i}") for i in range(2, 5)), F.var_pop("PCA_1"))
    return p.agg(F.count(F.lit(1)).alias("Customers"), F.rint(total * 100).cast("bigint").alias("TotalVariancePct"),
                 *[F.rint(F.abs(F.corr(f"PCA_{a}", f"PCA_{b}")) * 1000).cast("bigint").alias(f"Corr{a}{b}") for a, b in pairs])


def q_day_segments(spark, sf_dir):
    """C1-C5, G1 with order days as accounts: their number is no multiple of
    5, which tells quantile bins of ranks from ntile."""
    raw = account_lines(spark, sf_dir, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return customers_from_transactions(standardize_transactions(raw))


def q_line_slot_segments(spark, sf_dir):
    """The same with line numbers as accounts: seven of them."""
    return customers_from_transactions(standardize_transactions(account_lines(spark, sf_dir, F.col("l_linenumber"))))


def q_status_segments(spark, sf_dir):
    """C4: order states as accounts, fewer than there are bins."""
    return customers_from_transactions(standardize_transactions(account_lines(spark, sf_dir, F.col("o_orderstatus"))))


def q_legacy_day_rfm(spark, sf_dir):
    """I2L, I8L, C3: alias headers, missing spends, days as accounts."""
    _, customers = process_rfm_legacy_pipeline(legacy_alias_lines(spark, sf_dir))
    return customers


def q_features_gaps_aliased(spark, sf_dir):
    """F2, F6 with missing invoices and categories under aliases."""
    return compute_rfmt(standardize_transactions(gap_lines(spark, sf_dir, ("customer", "invoice", "date", "sales", "category"))))


def q_features_gaps(spark, sf_dir):
    """The same under canonical names, where nulls stay nulls."""
    return compute_rfmt(standardize_transactions(
        gap_lines(spark, sf_dir, ("CustomerID", "InvoiceNo", "PurchaseDate", "TotalSpend", "ProductCategory"))))


def q_legacy_action_list(spark, sf_dir):
    """G8 (five segments): every customer's goal, first action and channel."""
    _, customers = process_rfm_legacy_pipeline(orders_as_raw_transactions(spark, sf_dir))
    book = legacy_playbook_table(spark).select("Segment", "SegmentOrder", F.col("goal").alias("Goal"),
                                               F.element_at("actions", 1).alias("Action"), F.element_at("channels", 1).alias("Channel"))
    return customers.select("CustomerID", "Segment").join(F.broadcast(book), "Segment")   # five rows


def q_csv_records(spark, sf_dir):
    """Records with quoted line breaks, separators and doubled quotes;
    those with a field too many are kept apart and counted."""
    records, bad = csv_lines(spark, sf_dir)
    lines = standardize_transactions(records).groupBy("ProductCategory").agg(
        F.count(F.lit(1)).alias("Lines"), F.count_distinct("CustomerID").alias("Customers"), money_sum("TotalSpend").alias("Spend"))
    return lines.withColumn("BadRecords", F.lit(bad.count()))


def q_ingest_day_first(spark, sf_dir):
    """The column's dates choose day before month; ISO dates and text in
    it do not parse."""
    return standardize_transactions(dated_lines(spark, sf_dir), date_layout="elect")


def q_ingest_ambiguous_dates(spark, sf_dir):
    """No day after the 12th, so the rule decides for month before day."""
    return standardize_transactions(dated_lines(spark, sf_dir, last_day=12), date_layout="elect")


def q_invoice_numbers(spark, sf_dir):
    """I4: consecutive invoice numbers in file order."""
    return with_invoice_numbers(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))


def q_retail_clean_counts(spark, sf_dir):
    """Step counts that the cleaning job takes on its way."""
    clean, seen = clean_online_retail_counted(online_retail_raw(spark, sf_dir), f"retail-{uuid.uuid4().hex}")
    materialize(clean)
    found = seen.get
    names = ("RawRows", "RowsWithCustomer", "RowsPositive", "CleanRows", "FirstDate", "LastDate", "GrossRevenue")
    return spark.createDataFrame([tuple(found[n] for n in names)], "RawRows long, RowsWithCustomer long, RowsPositive long, CleanRows long, "
                                 "FirstDate string, LastDate string, GrossRevenue double")


def _two_parts(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of two files: invoices go on from the first to the second."""
    first = F.xxhash64("InvoiceNo", "TotalSpend") % 2 == 0
    return tx.where(first), tx.where(~first)


def q_customer_features_updated(spark, sf_dir):
    """the state of one part of the lines, kept as files, and
    brought up to date with the other part."""
    old, new = _two_parts(order_transactions(spark, sf_dir))
    path = f"{ensure_checkpoint_dir(spark)}/state-{uuid.uuid4().hex}"
    write_parquet(customer_state(old), path)
    write_parquet(merge_customer_states(read_export(spark, path), customer_state(new)), path)
    return features_of_state(read_export(spark, path))


def q_cohort_retention_merged(spark, sf_dir):
    """H3, H5: the triangle of two parts' merged states."""
    old, new = _two_parts(order_transactions(spark, sf_dir, with_product=False))
    return coh.retention_of_state(coh.merge_cohort_states(materialize(coh.cohort_state(old)), coh.cohort_state(new)))


def q_export_round_trip(spark, sf_dir):
    """K1: the customer table as a committed CSV export that takes the place
    of an earlier one, read back."""
    path = f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"
    customers = _customers(spark, sf_dir).select("CustomerID", "Segment", "Monetary", "RFM_Score")
    write_csv(customers.limit(1), path)
    write_csv(customers, path, order_by=[F.col("Monetary").desc(), "CustomerID"])
    return read_export(spark, path).withColumn("Monetary", F.col("Monetary").cast("double"))


def q_saved_model_scores(spark, sf_dir):
    """M1-M3, M7, M9: the fitted model, saved and loaded, places every customer
    where the unsaved one does."""
    customers = materialize(_customers(spark, sf_dir))
    model = fit_customer_model(customers)
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    names = ["ML_Cluster", "PCA_1", "PCA_2", "PCA_3"]
    a = model.transform(customers).select("CustomerID", F.struct(*names).alias("a"))
    b = PipelineModel.load(path).transform(customers).select(F.col("CustomerID").alias("id"), F.struct(*names).alias("b"))
    return a.join(b, F.col("CustomerID") == F.col("id")).agg(F.count(F.lit(1)).alias("Customers"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("Moved"),
                                                        F.count_distinct("a.ML_Cluster").alias("Clusters"))


def q_action_plan(spark, sf_dir):
    """R12 / K4 content: the full 34-column action plan."""
    plan, _, _ = build_action_plan(_valued(spark, sf_dir))
    return plan


QUERIES = {
    "customer_features": q_customer_features,
    "customer_features_events": q_customer_features_events,
    "customer_features_dashboard_snapshot": q_customer_features_dashboard_snapshot,
    "customer_segments": q_customer_segments,
    "customer_segments_events": q_customer_segments_events,
    "segment_summary": q_segment_summary,
    "segment_summary_events": q_segment_summary_events,
    "customer_value": q_customer_value,
    "customer_value_params": q_customer_value_params,
    "churn_watchlist": q_churn_watchlist,
    "churn_watchlist_top_quartile": q_churn_watchlist_top_quartile,
    "growth_targets": q_growth_targets,
    "cohort_retention": q_cohort_retention,
    "cohort_retention_events": q_cohort_retention_events,
    "cohort_sizes": q_cohort_sizes,
    "cohort_matrix": q_cohort_matrix,
    "cohort_heatmap": q_cohort_heatmap,
    "cohort_curve": q_cohort_curve,
    "cohort_benchmarks": q_cohort_benchmarks,
    "global_kpis": q_global_kpis,
    "churn_tiers": q_churn_tiers,
    "churn_tiers_events": q_churn_tiers_events,
    "p_alive_histogram": q_p_alive_histogram,
    "revenue_rollup": q_revenue_rollup,
    "revenue_share": q_revenue_share,
    "value_scatter": q_value_scatter,
    "watchlist_display": q_watchlist_display,
    "campaign_roi": q_campaign_roi,
    "roi_grid": q_roi_grid,
    "campaign_audience": q_campaign_audience,
    "segment_summary_display": q_segment_summary_display,
    "action_plan_core": q_action_plan_core,
    "legacy_rfm": q_legacy_rfm,
    "legacy_segment_summary": q_legacy_segment_summary,
    "ingest_dirty": q_ingest_dirty,
    "ingest_custom_mapping": q_ingest_custom_mapping,
    "ingest_keyword_picker": q_ingest_keyword_picker,
    "ingest_spend_from_price": q_ingest_spend_from_price,
    "customer_features_no_invoice": q_customer_features_no_invoice,
    "dirty_segments": q_dirty_segments,
    "retail_clean": q_retail_clean,
    "retail_profile": q_retail_profile,
    "transactions_profile": q_transactions_profile,
    "zscore_features": q_zscore_features,
    "silhouette_embeddings": q_silhouette_embeddings,
    "feature_correlations": q_feature_correlations,
    "segment_browser": q_segment_browser,
    "watchlist_top3": q_watchlist_top3,
    "feature_scatter": q_feature_scatter,
    "customer_lookup": q_customer_lookup,
    "kmeans_sweep": q_kmeans_sweep,
    "customer_clusters": q_customer_clusters,
    "pca_projection": q_pca_projection,
    "day_segments": q_day_segments,
    "line_slot_segments": q_line_slot_segments,
    "status_segments": q_status_segments,
    "legacy_day_rfm": q_legacy_day_rfm,
    "customer_features_gaps_aliased": q_features_gaps_aliased,
    "customer_features_gaps": q_features_gaps,
    "legacy_action_list": q_legacy_action_list,
    "cluster_profile_by_segment": q_cluster_profile_by_segment,
    "cluster_invariants": q_cluster_invariants,
    "pca_invariants": q_pca_invariants,
    "csv_records": q_csv_records,
    "ingest_day_first": q_ingest_day_first,
    "ingest_ambiguous_dates": q_ingest_ambiguous_dates,
    "invoice_numbers": q_invoice_numbers,
    "retail_clean_counts": q_retail_clean_counts,
    "customer_features_updated": q_customer_features_updated,
    "cohort_retention_merged": q_cohort_retention_merged,
    "export_round_trip": q_export_round_trip,
    "saved_model_scores": q_saved_model_scores,
    "action_plan": q_action_plan,
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The action plan: every stage from raw lines to the sorted export."""
    return q_action_plan(spark, sf_dir)
