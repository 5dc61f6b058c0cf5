"""Monthly acquisition-cohort retention.

The triangle is kept in long form ``(CohortMonth, CohortIndex,
ActiveCustomers, CohortSize, RetentionPct)``: a cell with no active
customer has no row (it is "absent", not 0 %), which is also what the
averages must skip.

Plan: transactions are first reduced to distinct (customer, month) pairs
(partial aggregation map-side, one shuffle). The cohort month is the
``min`` month over each customer's pairs (window partitioned by customer;
a customer has at most one row per calendar month, so no customer's group
grows with the data). Active counts per (cohort, index) are a plain
aggregate over those pairs with at most months x months output rows; the
cohort size (window per cohort), the first-13-observed-columns cut (dense
rank over that table) and the percentages work on that small table, so the
transactions are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.functions.dates import month_index
from retail_insight.functions.numeric import half_even
from retail_insight.session import materialize

DISPLAY_COLUMNS = 13  # Fixed value: month 0 .. month 12 when all are observed
WORD_MONTHS = 60      # months that share one bigint of a state; below 63, as signs are in the way


def customer_months(tx: DataFrame) -> DataFrame:
    """Distinct (customer, order month, cohort month, cohort index)."""
    pairs = (tx.where(F.col("CustomerID").isNotNull() & F.col("PurchaseDate").isNotNull())
             .select("CustomerID", F.date_trunc("month", "PurchaseDate").cast("date").alias("OrderMonth"))
             .distinct())
    first = F.min("OrderMonth").over(Window.partitionBy("CustomerID"))
    with_cohort = pairs.withColumn("CohortStart", first)
    return (with_cohort
            .withColumn("CohortIndex", month_index(F.col("CohortStart"), F.col("OrderMonth")))
            .where(F.col("CohortIndex") >= 0))


def cohort_retention(tx: DataFrame) -> DataFrame:
    """Long-form retention triangle, all observed cells."""
    cm = customer_months(tx)
    return _triangle(cm.groupBy("CohortStart", "CohortIndex").agg(F.count(F.lit(1)).alias("ActiveCustomers")))


def cohort_state(tx: DataFrame) -> DataFrame:
    """What cohorts need to know of some lines: (CustomerID, Word, Months), a
    bit for each month of a five-year span (``Word``) in which the customer
    bought. One small row for each customer and span, from one aggregate with
    map-side partial results; :func:`merge_cohort_states` adds later files."""
    month = (F.year("PurchaseDate") - 1970) * 12 + F.month("PurchaseDate") - 1
    seen = (tx.where(F.col("CustomerID").isNotNull() & F.col("PurchaseDate").isNotNull())
            .select("CustomerID", F.floor(month / WORD_MONTHS).cast("int").alias("Word"), F.pmod(month, F.lit(WORD_MONTHS)).alias("__bit")))
    return seen.groupBy("CustomerID", "Word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("Months"))


def merge_cohort_states(*states: DataFrame) -> DataFrame:
    """One state of several. Bits are joined with OR, so lines that are in more
    than one state, files in any order and late lines of earlier months all
    come out right."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("CustomerID", "Word").agg(F.bit_or("Months").alias("Months"))


def retention_of_state(state: DataFrame) -> DataFrame:
    """The retention triangle (as :func:`cohort_retention`) of a state."""
    lowest = F.bit_count(F.col("Months").bitwiseAND(-F.col("Months")) - 1)
    first = F.min(F.col("Word") * WORD_MONTHS + lowest).over(Window.partitionBy("CustomerID"))  # a row for each five years
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD_MONTHS - 1)), lambda i: F.call_function("shiftright", F.col("Months"), i).bitwiseAND(1) == 1)
    months = state.withColumn("__first", first).select("__first", "Word", F.explode(bits).alias("__bit"))
    start = F.make_date(1970 + F.floor(F.col("__first") / 12).cast("int"), F.pmod(F.col("__first"), F.lit(12)) + 1, F.lit(1))
    index = F.col("Word") * WORD_MONTHS + F.col("__bit") - F.col("__first")
    cells = months.groupBy("__first", index.alias("CohortIndex")).agg(F.count(F.lit(1)).alias("ActiveCustomers"))
    return _triangle(cells.select(start.alias("CohortStart"), "CohortIndex", "ActiveCustomers"))


def _triangle(cells: DataFrame) -> DataFrame:
    """Sizes and percentages of (CohortStart, CohortIndex, ActiveCustomers)."""
    # cells has at most (#months)^2 rows, so the window runs over a table
    # bounded by the calendar span, not by the data volume.
    size = F.max(F.when(F.col("CohortIndex") == 0, F.col("ActiveCustomers"))) \
        .over(Window.partitionBy("CohortStart"))
    cells = cells.withColumn("CohortSize", size)
    pct = F.col("ActiveCustomers") / F.col("CohortSize") * F.lit(100.0)
    pct = F.when(F.col("CohortIndex") == 0, F.lit(100.0)).otherwise(pct)
    pct = half_even(F.least(F.greatest(pct, F.lit(0.0)), F.lit(100.0)), 1)
    return cells.select(
        F.date_format("CohortStart", "yyyy-MM").alias("CohortMonth"),
        F.col("CohortIndex").cast("int").alias("CohortIndex"),
        F.col("ActiveCustomers"),
        F.col("CohortSize"),
        pct.alias("RetentionPct"),
    )


def first_month_columns(retention: DataFrame, columns: int = DISPLAY_COLUMNS) -> DataFrame:
    """The cells of the first ``columns`` observed month indices: what the
    matrix, the heatmap and the figures under it show."""
    position = F.dense_rank().over(Window.orderBy("CohortIndex"))   # over the cell table
    return retention.withColumn("__pos", position).where(F.col("__pos") <= columns).drop("__pos")


def cohort_sizes(tx: DataFrame) -> DataFrame:
    """Customers acquired per cohort month."""
    first = (tx.where(F.col("CustomerID").isNotNull() & F.col("PurchaseDate").isNotNull())
             .groupBy("CustomerID").agg(F.min("PurchaseDate").alias("__first")))
    return first.groupBy(F.date_format("__first", "yyyy-MM").alias("CohortMonth")).agg(F.count(F.lit(1)).alias("CohortSize"))


def cohort_matrix(retention: DataFrame, value_col: str = "RetentionPct") -> DataFrame:
    """Wide view: one row per cohort, one column per kept month index
    (``Month_<i>``), absent cells null. The pivot values are the kept
    indices (small integers, read from the data);
    the (months x months) retention table is materialised first so the
    input is not read twice."""
    retention = materialize(retention)
    idx = sorted(r[0] for r in retention.select("CohortIndex").distinct().collect())
    wide = (retention.groupBy("CohortMonth").pivot("CohortIndex", idx)
            .agg(F.first(value_col)))
    return wide.select("CohortMonth", *[F.col(str(i)).alias(f"Month_{i}") for i in idx])


def heatmap_cells(retention: DataFrame) -> DataFrame:
    """Heatmap feed: axis labels, whole-percent text and hover numbers."""
    return retention.select(
        F.concat(F.lit("Cohort "), F.col("CohortMonth")).alias("y_label"),
        F.concat(F.lit("Month "), F.col("CohortIndex").cast("string")).alias("x_label"),
        "CohortMonth", "CohortIndex",
        F.col("RetentionPct"),
        F.concat(F.rint(F.col("RetentionPct")).cast("bigint").cast("string"), F.lit("%")).alias("text"),
        F.col("ActiveCustomers"), F.col("CohortSize"),
    )


def _mean_of_tenths(c: str):
    # Values are already at 1 dp: add them as integer tenths (exact).
    return F.sum(F.rint(F.col(c) * F.lit(10.0)).cast("bigint")).cast("double") \
        / F.count(F.col(c)) / F.lit(10.0)


def average_retention_curve(retention: DataFrame) -> DataFrame:
    """Mean over cohorts of the rounded retention per month index (absent
    cells skipped), at 1 dp."""
    return (retention.groupBy("CohortIndex")
            .agg(half_even(_mean_of_tenths("RetentionPct"), 1).alias("AvgRetentionPct"))
            .orderBy("CohortIndex"))


def retention_benchmarks(retention: DataFrame, months=(1, 3, 6)) -> DataFrame:
    """Unrounded mean retention at the given month indices; 0 when the
    index is not among the kept columns."""
    aggs = []
    for m in months:
        vals = F.when(F.col("CohortIndex") == m, F.rint(F.col("RetentionPct") * F.lit(10.0)).cast("bigint"))
        mean = F.sum(vals).cast("double") / F.count(vals) / F.lit(10.0)
        aggs.append(F.coalesce(mean, F.lit(0.0)).alias(f"Month{m}RetentionPct"))
    return retention.agg(*aggs)
