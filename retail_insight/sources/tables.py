"""The driver's parquet tables seen as raw retail transactions.

These builders only rename and combine columns into the raw layout the
ingest operator expects (one row per order line); cleaning, coercion and
every metric happen in the operators.

Source A, order lines: ``lineitem JOIN orders JOIN part``. Both joins are
equi-joins that Catalyst plans: ``lineitem`` and ``orders`` are
co-partitioned on the order key by a shuffle (sort-merge join, AQE splits a
skewed order), and ``part`` is broadcast only when AQE measures it under
the broadcast threshold at runtime.

Source B, ``events``: each event is a one-line invoice with time of day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retail_insight.functions.numeric import half_even


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; Spark deals it out by its input splits."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_as_raw_transactions(spark: SparkSession, sf_dir: str,
                               with_product: bool = True) -> DataFrame:
    """Order lines with canonical column names (values not yet cleaned).

    ``with_product=False`` skips the ``part`` join for consumers that never
    read the product columns (cohorts, profiles); the category then takes
    the ingest default.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate")
    lines = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    cols = [
        F.col("o_custkey").cast("string").alias("CustomerID"),
        F.col("o_orderkey").cast("string").alias("InvoiceNo"),
        F.col("o_orderdate").alias("PurchaseDate"),
        half_even(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")), 2)
        .alias("TotalSpend"),
        F.col("l_quantity").alias("Quantity"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("UnitPrice"),
    ]
    if with_product:
        part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name")
        lines = lines.join(part, lines.l_partkey == part.p_partkey, "inner")
        cols += [F.col("p_name").alias("Product"), F.col("p_type").alias("ProductCategory")]
    return lines.select(*cols)


def events_as_raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw lines: no quantity, price or product columns, so the
    ingest defaults fill them (quantity 1, unit price = spend)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").cast("string").alias("CustomerID"),
        F.col("event_id").cast("string").alias("InvoiceNo"),
        F.col("ts").alias("PurchaseDate"),
        F.col("value").alias("TotalSpend"),
        F.col("event_type").alias("ProductCategory"),
    )
