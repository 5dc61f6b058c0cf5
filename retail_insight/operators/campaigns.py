"""Reporting and campaign data products over the customer table.

All of these are projections, small aggregates or per-segment arithmetic
on the (already aggregated) customer table. Per-segment results have at
most one row per segment; the scenario grid fans each segment row out over
a parameter grid with ``explode(sequence(...))`` (no join). The audience
list ranks customers inside each segment with :func:`distributed_rank`
(range-partitioned), since one segment may hold most customers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.functions.numeric import from_micros, half_even, micros, money_sum
from retail_insight.operators.ranking import distributed_rank
from retail_insight.operators.segments import playbook_table, segment_dim
from retail_insight.operators.value import TIERS

# Campaign model defaults and the empty-segment order value.
DEFAULT_REACH_PCT = 80
DEFAULT_BUDGET = 3500.0
DEFAULT_CONVERSION_PCT = 8.5
DEFAULT_MARGIN_PCT = 40.0
EMPTY_SEGMENT_AOV = 150.0
ACTIVE_MIN_P = 0.50
# Scenario ranges of the what-if inputs (start, stop, step).
REACH_RANGE = (10, 100, 5)
BUDGET_RANGE = (500, 50000, 500)
CONVERSION_RANGE = (1.0, 30.0, 0.5)
MARGIN_RANGE = (15, 85, 5)


def global_kpis(valued: DataFrame) -> DataFrame:
    """One row: customers, active (P_Alive >= 0.50) and active %, realised
    revenue, forecast spend and CLV, mean tenure."""
    n = F.count(F.lit(1))
    active = F.count_if(F.col("P_Alive") >= F.lit(ACTIVE_MIN_P))
    return valued.agg(
        n.alias("TotalCustomers"),
        active.alias("ActiveCustomers"),
        half_even(active / F.greatest(n, F.lit(1)) * F.lit(100.0), 1).alias("ActivePct"),
        half_even(money_sum("Monetary"), 2).alias("RealizedRevenue"),
        half_even(money_sum("Predicted_Spend_90d"), 2).alias("Forecast90dRevenue"),
        half_even(money_sum("Predictive_CLV_90d"), 2).alias("Forecast90dCLV"),
        half_even(F.sum("Tenure") / F.greatest(n, F.lit(1)), 1).alias("AvgTenureDays"),
    )


def churn_tier_counts(valued: DataFrame) -> DataFrame:
    """Count and share of each churn tier (0 for absent tiers)."""
    spark = valued.sparkSession
    dim = spark.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "Churn_Risk_Tier string, TierOrder int")
    counts = valued.groupBy("Churn_Risk_Tier").agg(F.count(F.lit(1)).alias("__n"))
    j = dim.join(F.broadcast(counts), "Churn_Risk_Tier", "left")     # <= 3 tier rows
    n = F.coalesce(F.col("__n"), F.lit(0))
    total = F.sum(n).over(Window.partitionBy())                     # over the 3 tier rows
    return (j.select("Churn_Risk_Tier", n.alias("Customers"),
                     half_even(n / F.greatest(total, F.lit(1)) * F.lit(100.0), 1).alias("SharePct"),
                     "TierOrder")
            .orderBy("TierOrder").drop("TierOrder"))


def p_alive_histogram(valued: DataFrame, bins: int = 30) -> DataFrame:
    """Counts per (tier, bin) of P_Alive_Pct over ``bins`` equal-width bins
    on [0, 100]; the last bin is closed."""
    width = 100.0 / bins
    b = F.least(F.floor(F.col("P_Alive_Pct") / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (valued.groupBy("Churn_Risk_Tier", b.alias("Bin"))
            .agg(F.count(F.lit(1)).alias("Customers"))
            .withColumns({"BinStart": half_even(F.col("Bin") * F.lit(width), 4),
                          "BinEnd": half_even((F.col("Bin") + F.lit(1)) * F.lit(width), 4)}))


def revenue_rollup(customers: DataFrame) -> DataFrame:
    """Segment -> customer revenue hierarchy (``rollup``): one row per
    customer, one subtotal per segment and a grand total."""
    return (customers.rollup("Segment", "CustomerID")
            .agg(money_sum("Monetary").alias("Revenue"),
                 F.grouping_id().cast("int").alias("Level")))


def value_scatter(valued: DataFrame) -> DataFrame:
    """Spend vs forecast scatter feed."""
    return valued.select("CustomerID", "Segment", "Monetary", "Predicted_Spend_90d", "P_Alive_Pct",
                         "Expected_Orders_90d", "Predictive_CLV_90d")


def _money_text(c: str) -> Column:
    return F.concat(F.lit("$"), F.format_number(F.col(c), 2))


def watchlist_display(watch: DataFrame) -> DataFrame:
    """Ten display columns with ``$1,234.56``, ``12.3%`` and ``N days`` text."""
    return watch.select(
        "CustomerID", "Segment",
        F.concat(F.format_string("%.1f", F.col("P_Alive_Pct")), F.lit("%")).alias("P_Alive_Pct"),
        "Churn_Risk_Tier",
        _money_text("Monetary").alias("Monetary"),
        "Frequency",
        F.concat(F.col("Recency").cast("string"), F.lit(" days")).alias("Recency"),
        "Tenure",
        _money_text("AvgOrderValue").alias("AvgOrderValue"),
        "TopCategory",
    )


def _segment_stats(customers: DataFrame) -> DataFrame:
    """Per segment (all 7): size and mean order value (null when empty)."""
    spark = customers.sparkSession
    per = customers.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("SegmentCustomers"),
        F.sum(micros("AvgOrderValue")).alias("__aov"))
    j = segment_dim(spark).join(F.broadcast(per), "Segment", "left")   # <= 7 rows each
    n = F.coalesce(F.col("SegmentCustomers"), F.lit(0))
    aov = from_micros("__aov") / F.col("SegmentCustomers")
    return j.select("Segment", "SegmentOrder", n.alias("SegmentCustomers"),
                    F.coalesce(aov, F.lit(EMPTY_SEGMENT_AOV)).alias("__seg_aov"))


def _roi_columns(n: Column, aov: Column, reach: Column, budget: Column, conv: Column,
                 margin: Column) -> dict[str, Column]:
    audience = F.floor(n * (reach / F.lit(100.0))).cast("bigint")
    conversions = audience * (conv / F.lit(100.0))
    gross = conversions * aov
    profit = gross * (margin / F.lit(100.0))
    net = profit - budget
    return {
        "Audience": audience,
        "AvgSegmentAOV": half_even(aov, 2),
        "ProjectedConversions": half_even(conversions, 2),
        "ProjectedRevenue": half_even(gross, 2),
        "GrossProfit": half_even(profit, 2),
        "NetProfit": half_even(net, 2),
        "ROIPct": half_even(net / F.greatest(budget, F.lit(1.0)) * F.lit(100.0), 1),
        "CostPerConversion": half_even(budget / F.greatest(conversions, F.lit(1.0)), 2),
    }


def campaign_roi(customers: DataFrame, reach_pct: float = DEFAULT_REACH_PCT,
                 budget: float = DEFAULT_BUDGET, conversion_pct: float = DEFAULT_CONVERSION_PCT,
                 margin_pct: float = DEFAULT_MARGIN_PCT, segments: Sequence[str] | None = None) -> DataFrame:
    """Campaign financials per segment for one set of inputs: audience =
    int(segment size x reach %), conversions, revenue at the segment's mean
    order value (150.0 for an empty segment), profit, net, ROI %, CPA."""
    stats = _segment_stats(customers)
    if segments:
        stats = stats.where(F.col("Segment").isin(*segments))
    cols = _roi_columns(F.col("SegmentCustomers"), F.col("__seg_aov"), F.lit(float(reach_pct)),
                        F.lit(float(budget)), F.lit(float(conversion_pct)), F.lit(float(margin_pct)))
    return (stats.withColumns(cols).withColumns({
        "ReachPct": F.lit(float(reach_pct)), "Budget": F.lit(float(budget)),
        "ConversionPct": F.lit(float(conversion_pct)), "MarginPct": F.lit(float(margin_pct))})
        .orderBy("SegmentOrder").drop("SegmentOrder", "__seg_aov"))


def _grid(rng) -> Column:
    start, stop, step = rng
    if all(isinstance(v, int) for v in rng):
        return F.sequence(F.lit(start), F.lit(stop), F.lit(step)).cast("array<double>")
    k = int(round((stop - start) / step))
    idx = F.sequence(F.lit(0), F.lit(k))
    return F.transform(idx, lambda i: F.lit(float(start)) + i.cast("double") * F.lit(float(step)))


def roi_grid(customers: DataFrame, reach=REACH_RANGE, budget=BUDGET_RANGE,
             conversion=CONVERSION_RANGE, margin=MARGIN_RANGE) -> DataFrame:
    """ROI for every segment over a grid of campaign inputs (each range is
    (start, stop, step)); one output row per (segment, scenario)."""
    stats = _segment_stats(customers)
    grid = (stats
            .withColumn("ReachPct", F.explode(_grid(reach)))
            .withColumn("Budget", F.explode(_grid(budget)))
            .withColumn("ConversionPct", F.explode(_grid(conversion)))
            .withColumn("MarginPct", F.explode(_grid(margin))))
    cols = _roi_columns(F.col("SegmentCustomers"), F.col("__seg_aov"), F.col("ReachPct"),
                        F.col("Budget"), F.col("ConversionPct"), F.col("MarginPct"))
    return grid.withColumns(cols).drop("SegmentOrder", "__seg_aov")


def best_scenarios(grid: DataFrame) -> DataFrame:
    """Scenario with the highest net profit per segment (ties: smaller
    budget, then lower reach, conversion and margin)."""
    key = F.struct(F.col("NetProfit"), -F.col("Budget"), -F.col("ReachPct"),
                   -F.col("ConversionPct"), -F.col("MarginPct"))
    best = F.max_by(F.struct(*[F.col(c) for c in grid.columns if c != "Segment"]), key)
    return grid.groupBy("Segment").agg(best.alias("b")).select("Segment", "b.*")


def campaign_audience(customers: DataFrame, reach_pct: float = DEFAULT_REACH_PCT,
                      segments: Sequence[str] | None = None) -> DataFrame:
    """First int(size x reach %) customers of each segment in customer-id
    order (the exported target list). Ranks a narrow (id, segment)
    projection and joins the selected ids back to the full rows."""
    base = customers if not segments else customers.where(F.col("Segment").isin(*segments))
    ranked = distributed_rank(base.select("CustomerID", "Segment"), [], "CustomerID",
                              rank_col="AudienceRank", total_col="__seg_n", partition_by=["Segment"])
    limit = F.floor(F.col("__seg_n") * F.lit(float(reach_pct) / 100.0))
    chosen = ranked.where(F.col("AudienceRank") <= limit).select("CustomerID", "AudienceRank")
    return base.join(chosen, "CustomerID", "inner")


# Display names of the segment summary columns.
SUMMARY_DISPLAY_NAMES = {
    "CustomerCount": "Customers",
    "CustomerSharePct": "Cust %",
    "TotalRevenue": "Total Revenue ($)",
    "RevenueSharePct": "Rev %",
    "AvgRevenue": "Avg Spend / Cust ($)",
    "AvgRecency": "Avg Recency (Days)",
    "AvgFrequency": "Avg Orders",
    "AvgTenure": "Avg Tenure (Days)",
    "AvgAOV": "Avg AOV ($)",
}


def segment_summary_display(summary: DataFrame) -> DataFrame:
    return summary.withColumnsRenamed(SUMMARY_DISPLAY_NAMES)


def revenue_share(summary: DataFrame) -> DataFrame:
    """Revenue vs customer share per segment (donut / share comparison)."""
    return summary.select("Segment", "TotalRevenue", "RevenueSharePct", "CustomerSharePct")


#: Rows up to which a caller's playbook table is broadcast.
MAX_BROADCAST_PLAYBOOKS = 1000


def enrich_with_playbook(customers: DataFrame, playbooks: DataFrame | None = None) -> DataFrame:
    """Objective, channel, promotion, first action, email subject and CTA
    of the customer's segment ('' when the segment has no playbook). A table
    of the caller's must name each segment once; it is only broadcast if it is
    as small as such tables are."""
    pb, small = playbooks, False
    if pb is None:
        pb, small = playbook_table(customers.sparkSession), True   # a row for each of seven segments
    else:
        seen = pb.agg(F.count("Segment").alias("n"), F.count_distinct("Segment").alias("segments")).first()
        if seen["n"] != seen["segments"]:
            raise ValueError("the playbook table names a segment more than once")
        small = seen["n"] <= MAX_BROADCAST_PLAYBOOKS
    cols = pb.select(
        F.col("Segment").alias("__pb_seg"),
        F.col("objective").alias("Strategic_Objective"),
        F.col("best_channel").alias("Recommended_Channel"),
        F.col("promo_type").alias("Recommended_Promotion"),
        F.element_at(F.col("actions"), 1).alias("Primary_Action_Item"),
        F.col("campaign_template.subject").alias("Campaign_Email_Subject"),
        F.col("campaign_template.cta").alias("Campaign_CTA"),
    )
    j = customers.join(F.broadcast(cols) if small else cols, F.col("Segment") == F.col("__pb_seg"), "left").drop("__pb_seg")
    fill = {c: "" for c in ("Strategic_Objective", "Recommended_Channel", "Recommended_Promotion",
                            "Primary_Action_Item", "Campaign_Email_Subject", "Campaign_CTA")}
    return j.fillna(fill)


# Action-plan columns in output order.
ACTION_PLAN_COLUMNS = (
    "CustomerID", "Segment", "ML_Cluster", "Churn_Risk_Tier", "P_Alive_Pct", "Churn_Risk_Pct",
    "Recency", "Frequency", "Monetary", "Tenure", "AvgOrderValue", "TopCategory",
    "R_Score", "F_Score", "M_Score", "T_Score", "RFM_Score", "RFMT_Mean",
    "Expected_Orders_90d", "Predicted_Spend_90d", "Predictive_CLV_90d",
    "PCA_1", "PCA_2", "PCA_3",
    "Strategic_Objective", "Recommended_Channel", "Recommended_Promotion",
    "Primary_Action_Item", "Campaign_Email_Subject", "Campaign_CTA",
    "FirstPurchase", "LastPurchase", "TotalItems", "TotalTransactions",
)


def action_plan(enriched: DataFrame, columns: Sequence[str] = ACTION_PLAN_COLUMNS) -> DataFrame:
    """Project the export columns and sort by Monetary desc, CLV desc,
    customer id (a distributed range sort)."""
    return (enriched.select(*columns)
            .orderBy(F.col("Monetary").desc(), F.col("Predictive_CLV_90d").desc(), F.col("CustomerID").asc()))


def feature_correlations(customers: DataFrame, cols=("Recency", "Frequency", "Monetary", "Tenure")) -> DataFrame:
    """Pearson correlation for every feature pair (one aggregate pass)."""
    aggs, names = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(half_even(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6)
                        .alias(f"{a}__{b}"))
            names.append((a, b))
    row = customers.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(a).alias("FeatureA"), F.lit(b).alias("FeatureB"),
                               F.col(f"{a}__{b}").alias("Correlation")) for a, b in names])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def feature_scatter(customers: DataFrame) -> DataFrame:
    return customers.select("CustomerID", "Segment", "Recency", "Frequency", "Monetary", "Tenure")


def customer_lookup(customers: DataFrame, customer_id: str) -> DataFrame:
    return customers.where(F.col("CustomerID") == F.lit(customer_id))


def filter_and_sort(customers: DataFrame, segments: Sequence[str] | None = None,
                    sort_by: Sequence[tuple[str, bool]] = (("Monetary", False),)) -> DataFrame:
    out = customers if not segments else customers.where(F.col("Segment").isin(*segments))
    keys = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in sort_by] + [F.col("CustomerID").asc()]
    return out.orderBy(*keys)

