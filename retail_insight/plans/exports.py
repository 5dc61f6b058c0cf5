"""File exports of the data products (CSV with header by default).

Sorted exports are written as ordered part files (``orderBy`` is a range
sort; part-00000 holds the first range), never funnelled into one task. An
export takes the place of an earlier one only when it is complete; read it
with :func:`retail_insight.sources.sinks.read_export`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.operators.campaigns import campaign_audience
from retail_insight.operators.ingest import clean_online_retail_counted
from retail_insight.operators.value import churn_watchlist
from retail_insight.session import materialize
from retail_insight.sources.sinks import write_csv


def export_customers(valued: DataFrame, path: str) -> None:
    """K1: the full customer table (every column)."""
    write_csv(valued, path)


def export_watchlist(valued: DataFrame, path: str, p_alive_threshold: float = 0.45) -> None:
    """K2: churn watchlist, highest spend first."""
    write_csv(churn_watchlist(valued, p_alive_threshold), path,
              order_by=[F.col("Monetary").desc(), F.col("CustomerID").asc()])


def export_audience(valued: DataFrame, path: str, segment: str, reach_pct: float = 80) -> None:
    """K3: the targeted audience of one segment, in customer-id order."""
    aud = campaign_audience(valued, reach_pct, [segment]).drop("AudienceRank")
    write_csv(aud, path, order_by=["CustomerID"])


def export_action_plan(plan: DataFrame, path: str) -> None:
    """K4: the 34-column action plan, in plan order."""
    write_csv(plan, path, order_by=[F.col("Monetary").desc(), F.col("Predictive_CLV_90d").desc(),
                                    F.col("CustomerID").asc()])


def export_clean_retail(raw: DataFrame, path: str) -> dict:
    """K5: cleaned retail lines sorted by purchase date. Returns the counts of
    the cleaning steps (I14), taken by the job that cleans; the raw lines are
    read once, and the sort and the distinct customers work on the result."""
    clean, seen = clean_online_retail_counted(raw)
    clean = materialize(clean)
    write_csv(clean, path, order_by=["PurchaseDate", "InvoiceNo"])
    return {**seen.get, "Customers": clean.agg(F.count_distinct("CustomerID")).first()[0]}
