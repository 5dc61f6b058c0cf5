"""Rule-based segments, their metadata, playbooks and KPI summaries.

Segment rules are first-match ``CASE WHEN`` chains over the integer scores
(and tenure days for new customers): pure expressions, no UDF. Icons and
colours are literal map lookups (no join). The KPI summaries aggregate per
segment (partial + final aggregate, at most one row per segment) and then
left-join from the segment dimension so every segment appears even when
empty; shares divide by totals taken over those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retail_insight.functions.numeric import from_micros, half_even, micros

# Segment names in display order, icons and colours.
SEGMENTS = ("Champions", "Loyalists", "Potential Growth", "At-Risk VIPs",
            "Can't Lose Them", "Hibernating", "New Customers")
SEGMENT_ICONS = {
    "Champions": "👑", "Loyalists": "💎", "Potential Growth": "🚀", "At-Risk VIPs": "⚠️",
    "Can't Lose Them": "🚨", "Hibernating": "💤", "New Customers": "🌱",
}
SEGMENT_COLORS = {
    "Champions": "#10B981", "Loyalists": "#3B82F6", "Potential Growth": "#8B5CF6",
    "At-Risk VIPs": "#F59E0B", "Can't Lose Them": "#EF4444", "Hibernating": "#64748B",
    "New Customers": "#06B6D4",
}
NEW_CUSTOMER_MAX_TENURE = 65

LEGACY_SEGMENTS = ("Champions", "Loyal Customers", "New/Promising", "At Risk", "Lost/Inactive")
LEGACY_ICONS = {
    "Champions": "👑", "Loyal Customers": "💎", "New/Promising": "🌱", "At Risk": "⚠️",
    "Lost/Inactive": "💤",
}
LEGACY_COLORS = {
    "Champions": "#10B981", "Loyal Customers": "#3B82F6", "New/Promising": "#8B5CF6",
    "At Risk": "#F59E0B", "Lost/Inactive": "#EF4444",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segment_rule(r="R_Score", f="F_Score", m="M_Score", tenure="Tenure") -> Column:
    """Seven-segment first-match chain."""
    r, f, m, t = _c(r), _c(f), _c(m), _c(tenure)
    return (
        F.when((t <= NEW_CUSTOMER_MAX_TENURE) & (r >= 4) & (f <= 2), "New Customers")
        .when(((r >= 4) & (f >= 4) & (m >= 4)) | ((r == 5) & (f >= 3) & (m >= 4)), "Champions")
        .when((r == 1) & ((f >= 4) | (m >= 4)), "Can't Lose Them")
        .when((r <= 2) & ((m >= 3) | (f >= 3)), "At-Risk VIPs")
        .when(((r >= 4) & (f <= 3)) | ((r >= 3) & (m >= 4)), "Potential Growth")
        .when(((r >= 3) & (f >= 3)) | ((r >= 2) & (f >= 4) & (m >= 3)), "Loyalists")
        .otherwise("Hibernating")
    )


def legacy_segment_rule(r="R_Score", f="F_Score", m="M_Score") -> Column:
    """Five-segment first-match chain on 1..4 scores."""
    r, f, m = _c(r), _c(f), _c(m)
    return (
        F.when(((r == 4) & (f >= 3) & (m >= 3)) | ((r >= 3) & (f == 4) & (m == 4))
               | ((r == 4) & (f == 4)), "Champions")
        .when(((r >= 3) & (f >= 3)) | ((r >= 2) & (f >= 3) & (m >= 3)) | ((r >= 3) & (m >= 3)),
              "Loyal Customers")
        .when((r >= 3) & (f <= 2), "New/Promising")
        .when((r <= 2) & ((f >= 2) | (m >= 3)), "At Risk")
        .otherwise("Lost/Inactive")
    )


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), key)


def assign_segments(scored: DataFrame, taxonomy: str = "seven") -> DataFrame:
    """Add ``Segment``, ``Segment_Order`` (0 for the first in display order),
    ``Segment_Icon``, ``Segment_Color``."""
    if taxonomy == "seven":
        names, seg, icons, colors = SEGMENTS, segment_rule(), SEGMENT_ICONS, SEGMENT_COLORS
    else:
        names, seg, icons, colors = LEGACY_SEGMENTS, legacy_segment_rule(), LEGACY_ICONS, LEGACY_COLORS
    out = scored.withColumn("Segment", seg)
    return out.withColumns({
        "Segment_Order": _lookup({n: i for i, n in enumerate(names)}, F.col("Segment")),
        "Segment_Icon": _lookup(icons, F.col("Segment")),
        "Segment_Color": _lookup(colors, F.col("Segment")),
    })


# ---------------------------------------------------------------- playbooks
# Structure of a playbook row; the copy text below is this library's own
# default and can be replaced by passing another table with this schema.
PLAYBOOK_SCHEMA = T.StructType([
    T.StructField("Segment", T.StringType(), False),
    T.StructField("SegmentOrder", T.IntegerType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("icon", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("badge", T.StringType()),
    T.StructField("profile", T.StringType()),
    T.StructField("objective", T.StringType()),
    T.StructField("best_channel", T.StringType()),
    T.StructField("promo_type", T.StringType()),
    T.StructField("actions", T.ArrayType(T.StringType())),
    T.StructField("campaign_template", T.StructType([
        T.StructField("subject", T.StringType()),
        T.StructField("headline", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("cta", T.StringType()),
    ])),
])

# Where each segment stands: what its customers spend, and whether they still buy.
_STANDING = {
    "Champions": ("high", "active"), "Loyalists": ("steady", "active"), "Potential Growth": ("growing", "active"),
    "At-Risk VIPs": ("high", "slowing"), "Can't Lose Them": ("high", "gone"), "Hibernating": ("low", "gone"),
    "New Customers": ("first", "active"),
}
_AIM = {"active": "Hold the present order rhythm", "slowing": "Bring the order rhythm back", "gone": "Find out who can still be reached"}
_CHANNEL = {"high": "Account contact", "steady": "Newsletter", "growing": "Product pages", "low": "Unpaid e-mail", "first": "Order mail"}
_OFFER = {"active": "None needed; thank-you note", "slowing": "Dated voucher", "gone": "Single test voucher"}


def playbook_rows() -> list[tuple]:
    """A plain default for each segment, put together from its standing."""
    rows = []
    for i, name in enumerate(SEGMENTS):
        spend, state = _STANDING[name]
        rows.append((
            name, i, name, SEGMENT_ICONS[name], SEGMENT_COLORS[name], f"{spend} spend, {state}".capitalize(),
            f"Customers of {spend} spend who are {state}.", f"{_AIM[state]}.", _CHANNEL[spend], _OFFER[state],
            [f"List {name} by last order date.", f"Contact them by: {_CHANNEL[spend].lower()}.", "Compare orders before and after."],
            (f"A note to our {name} customers", f"{_AIM[state]}.", "Hello {Customer_Name}, here is what is new.", "See what is new")))
    return rows


def playbook_table(spark: SparkSession) -> DataFrame:
    """Seven-row playbook dimension (one row per segment, display order)."""
    return spark.createDataFrame(playbook_rows(), PLAYBOOK_SCHEMA)


LEGACY_PLAYBOOK_SCHEMA = T.StructType([
    T.StructField("Segment", T.StringType(), False),
    T.StructField("SegmentOrder", T.IntegerType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("icon", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("goal", T.StringType()),
    T.StructField("actions", T.ArrayType(T.StringType())),
    T.StructField("channels", T.ArrayType(T.StringType())),
    T.StructField("sample_campaign", T.StructType([
        T.StructField("subject", T.StringType()),
        T.StructField("body", T.StringType()),
    ])),
])

_LEGACY_STANDING = {
    "Champions": ("high", "active"), "Loyal Customers": ("steady", "active"), "New/Promising": ("first", "active"),
    "At Risk": ("steady", "slowing"), "Lost/Inactive": ("low", "gone"),
}


def legacy_playbook_rows() -> list[tuple]:
    """The same default for the five segments."""
    return [(name, i, name, LEGACY_ICONS[name], LEGACY_COLORS[name], f"Customers of {spend} spend who are {state}.", f"{_AIM[state]}.",
             [f"List {name} by last order date.", "Compare orders before and after."], [_CHANNEL[spend]],
             (f"A note to our {name} customers", "Hello {Customer_Name}, here is what is new."))
            for i, name in enumerate(LEGACY_SEGMENTS) for spend, state in [_LEGACY_STANDING[name]]]


def legacy_playbook_table(spark: SparkSession) -> DataFrame:
    """Five-row playbook dimension."""
    return spark.createDataFrame(legacy_playbook_rows(), LEGACY_PLAYBOOK_SCHEMA)


def segment_dim(spark: SparkSession, taxonomy: str = "seven") -> DataFrame:
    names = SEGMENTS if taxonomy == "seven" else LEGACY_SEGMENTS
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)],
                                 "Segment string, SegmentOrder int")


# ---------------------------------------------------------------- KPI summary

def segment_kpi_summary(customers: DataFrame, taxonomy: str = "seven") -> DataFrame:
    """One row per segment (all of them, empty ones with count 0, revenue
    0.0 and null means): count, revenue, mean revenue / recency / frequency
    (/ tenure) / AOV, customer and revenue shares (1 dp)."""
    spark = customers.sparkSession
    aggs = [
        F.count(F.lit(1)).alias("__n"),
        F.sum(micros("Monetary")).alias("__rev"),
        F.sum("Recency").alias("__rec"),
        F.sum("Frequency").alias("__freq"),
        F.sum(micros("AvgOrderValue")).alias("__aov"),
    ]
    if taxonomy == "seven":
        aggs.append(F.sum("Tenure").alias("__ten"))
    per_seg = customers.groupBy("Segment").agg(*aggs)
    dim = segment_dim(spark, taxonomy)
    # The rule emits only the dimension's names, so the aggregate has at most
    # one row per segment: a proven bound for the broadcast.
    j = dim.join(F.broadcast(per_seg), "Segment", "left")
    n = F.coalesce(F.col("__n"), F.lit(0))
    rev = F.coalesce(from_micros("__rev"), F.lit(0.0))
    mean = lambda c: F.col(c).cast("double") / F.col("__n")
    money_mean = lambda c: from_micros(c) / F.col("__n")
    everything = Window.partitionBy()     # over the few segment rows only
    cols = [
        F.col("Segment"),
        n.alias("CustomerCount"),
        rev.alias("TotalRevenue"),
        half_even(money_mean("__rev"), 2).alias("AvgRevenue"),
        half_even(mean("__rec"), 1).alias("AvgRecency"),
        half_even(mean("__freq"), 1).alias("AvgFrequency"),
    ]
    if taxonomy == "seven":
        cols.append(half_even(mean("__ten"), 1).alias("AvgTenure"))
    cols += [
        half_even(money_mean("__aov"), 2).alias("AvgAOV"),
        half_even(n / F.greatest(F.sum(n).over(everything), F.lit(1)) * F.lit(100.0), 1)
        .alias("CustomerSharePct"),
        half_even(rev / F.greatest(F.sum(rev).over(everything), F.lit(1.0)) * F.lit(100.0), 1)
        .alias("RevenueSharePct"),
        F.col("SegmentOrder"),
    ]
    return j.select(*cols).orderBy("SegmentOrder").drop("SegmentOrder")
