"""Per-customer features: recency, frequency, monetary, tenure, top category.

Plan shape (see ``explain``): the transactions are read once.
``GROUPING SETS ((customer, invoice), (customer, category))`` produces
invoice rows and category rows in one aggregate (partial aggregation on
the map side, one shuffle); a second aggregate by customer then counts
invoice rows (Frequency), sums them (spend, items, lines), and picks the
top category as ``min(struct(-spend, category))`` over category rows (again
combined map-side, one shuffle). No step needs all lines of one customer
in one task, so a customer holding a third of all lines costs one partial
row per map task, and there is no join and no second scan.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.functions.dates import floor_days
from retail_insight.functions.numeric import from_micros, half_even, micros
from retail_insight.session import materialize

FEATURE_COLUMNS = ("CustomerID", "FirstPurchase", "LastPurchase", "Frequency", "Monetary",
                   "TotalItems", "TotalTransactions", "Recency", "Tenure", "AvgOrderValue")
DEFAULT_TOP_CATEGORY = "General Merchandise"
DEFAULT_FAVORITE_PRODUCT = "N/A"


def snapshot_after_last(tx: DataFrame, date_col: str = "PurchaseDate") -> Column:
    """Snapshot instant = latest purchase + 1 day (time of day kept)."""
    return tx.select((F.max(date_col) + F.expr("INTERVAL 1 DAY")).alias("s")).scalar()


def snapshot_next_midnight(raw_dates: DataFrame, date_col: str) -> Column:
    """Dashboard snapshot: midnight of the day after the latest parseable
    date in the raw (uncleaned) rows."""
    from retail_insight.functions.dates import parse_timestamp
    types = {f.name: f.dataType for f in raw_dates.schema.fields}
    d = parse_timestamp(F.col(f"`{date_col}`"), types.get(date_col))
    return raw_dates.select(
        F.date_trunc("day", F.max(d) + F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("s")
    ).scalar()


def _snapshot_column(tx: DataFrame, customers: DataFrame, snapshot_date) -> Column:
    if snapshot_date is None:
        # max over customers' last purchase == max over all lines, but reads
        # the (much smaller) aggregated frame.
        return snapshot_after_last(customers, "LastPurchase")
    if isinstance(snapshot_date, Column):
        return snapshot_date
    if isinstance(snapshot_date, (_dt.date, _dt.datetime)):
        snapshot_date = snapshot_date.isoformat(sep=" ") if isinstance(snapshot_date, _dt.datetime) \
            else snapshot_date.isoformat()
    return F.lit(str(snapshot_date)).cast("timestamp_ntz")


def _customer_aggregate(tx: DataFrame, item: str, weight: str) -> DataFrame:
    """Per-customer totals plus the top ``item`` by ``weight`` ("spend" or
    "quantity"), from one grouping-sets aggregate and one customer
    aggregate."""
    return _customer_totals(_invoice_and_item_rows(tx, item), item, weight)


def _invoice_and_item_rows(tx: DataFrame, item: str) -> DataFrame:
    """A row for each invoice and one for each ``item`` of a customer."""
    sets = tx.groupingSets([["CustomerID", "InvoiceNo"], ["CustomerID", item]],
                           "CustomerID", "InvoiceNo", item)
    return sets.agg(
        F.grouping("InvoiceNo").alias("__is_item"),
        F.min("PurchaseDate").alias("__first"),
        F.max("PurchaseDate").alias("__last"),
        F.sum(micros("TotalSpend")).alias("__micros"),
        F.sum("Quantity").alias("__qty"),
        F.count("InvoiceNo").alias("__lines"),
    )


def customer_state(tx: DataFrame) -> DataFrame:
    """What customer features need to know of some canonical lines: each
    customer's invoices and categories with their sums and first and last
    dates. Keep it (:func:`retail_insight.sources.sinks.write_parquet`) and add
    later lines with :func:`merge_customer_states`; the lines themselves need
    not be read again."""
    return _invoice_and_item_rows(tx, "ProductCategory")


def merge_customer_states(*states: DataFrame) -> DataFrame:
    """One state of several whose lines do not overlap. An invoice that goes on
    in later lines is one invoice; sums are exact, so the order and number of
    parts do not matter. One aggregate with map-side partial results."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy("CustomerID", "InvoiceNo", "ProductCategory", "__is_item").agg(
        F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.sum("__micros").cast("decimal(38,0)").alias("__micros"),
        F.sum("__qty").alias("__qty"), F.sum("__lines").alias("__lines"))


def features_of_state(state: DataFrame, snapshot_date=None, with_top_category: bool = True) -> DataFrame:
    """The customer table (as :func:`compute_rfmt`) of a state."""
    return _rfmt(_customer_totals(state, "ProductCategory", "spend"), None, snapshot_date, with_top_category)


def _customer_totals(g: DataFrame, item: str, weight: str) -> DataFrame:
    inv_row = F.col("__is_item") == 0
    item_row = F.col("__is_item") == 1
    w = F.col("__micros") if weight == "spend" else F.col("__qty")
    return g.groupBy("CustomerID").agg(
        F.min("__first").alias("FirstPurchase"),
        F.max("__last").alias("LastPurchase"),
        F.count_if(inv_row & F.col("InvoiceNo").isNotNull()).alias("Frequency"),
        from_micros(F.sum(F.when(inv_row, F.col("__micros")))).alias("__spend"),
        F.sum(F.when(inv_row, F.col("__qty"))).alias("TotalItems"),
        F.sum(F.when(inv_row, F.col("__lines"))).alias("TotalTransactions"),
        F.min(F.when(item_row & F.col(item).isNotNull(), F.struct((-w).alias("neg_w"), F.col(item).alias("item"))))
        .getField("item").alias("__top"),
    )


def _with_snapshot(tx: DataFrame, agg: DataFrame, snapshot_date) -> tuple[DataFrame, Column]:
    """Materialise the customer aggregate when the snapshot is derived from
    the data, and read the snapshot (one value) from the aggregate files
    instead of re-running the scan, joins and shuffles of the transactions;
    it then enters the plan as a literal."""
    if snapshot_date is None:
        agg = materialize(agg)
        latest = agg.agg(F.max("LastPurchase").alias("m")).first()["m"]
        if latest is None:
            return agg, F.lit(None).cast("timestamp_ntz")
        snap = (latest + _dt.timedelta(days=1)).isoformat(sep=" ")
        return agg, F.lit(snap).cast("timestamp_ntz")
    return agg, _snapshot_column(tx, agg, snapshot_date)


def compute_rfmt(tx: DataFrame, snapshot_date=None, with_top_category: bool = True) -> DataFrame:
    """Customer table from canonical transactions.

    Recency = whole days from last purchase to the snapshot (>= 0), Tenure =
    whole days from first purchase (>= 1), Frequency = distinct invoices,
    Monetary = spend sum at 2 dp, AvgOrderValue = Monetary / Frequency at
    2 dp, TopCategory = category with the largest spend (ties -> smallest
    name; lines without a category count for none). ``snapshot_date``: None (latest purchase + 1 day), a date /
    datetime / ISO string, or a timestamp Column.
    """
    return _rfmt(_customer_aggregate(tx, "ProductCategory", "spend"), tx, snapshot_date, with_top_category)


def _rfmt(agg: DataFrame, tx: DataFrame | None, snapshot_date, with_top_category: bool) -> DataFrame:
    agg, snap = _with_snapshot(tx, agg, snapshot_date)
    monetary = half_even(F.col("__spend"), 2)
    cols = [
        "CustomerID", "FirstPurchase", "LastPurchase", "Frequency",
        monetary.alias("Monetary"), "TotalItems", "TotalTransactions",
        F.greatest(floor_days(F.col("LastPurchase"), snap), F.lit(0)).alias("Recency"),
        F.greatest(floor_days(F.col("FirstPurchase"), snap), F.lit(1)).alias("Tenure"),
        half_even(monetary / F.greatest(F.col("Frequency"), F.lit(1)), 2).alias("AvgOrderValue"),
    ]
    if with_top_category:
        cols.append(F.coalesce(F.col("__top"), F.lit(DEFAULT_TOP_CATEGORY)).alias("TopCategory"))
    return agg.select(*cols)


def compute_rfm_legacy(tx: DataFrame, snapshot_date=None) -> DataFrame:
    """Five-segment variant: no tenure, favourite product by summed quantity
    (missing -> "N/A")."""
    agg = _customer_aggregate(tx, "Product", "quantity")
    agg, snap = _with_snapshot(tx, agg, snapshot_date)
    monetary = half_even(F.col("__spend"), 2)
    return agg.select(
        "CustomerID",
        F.greatest(floor_days(F.col("LastPurchase"), snap), F.lit(0)).alias("Recency"),
        "Frequency", monetary.alias("Monetary"), "FirstPurchase", "LastPurchase",
        "TotalItems", "TotalTransactions",
        half_even(monetary / F.greatest(F.col("Frequency"), F.lit(1)), 2).alias("AvgOrderValue"),
        F.coalesce(F.col("__top"), F.lit(DEFAULT_FAVORITE_PRODUCT)).alias("FavoriteProduct"),
    )
