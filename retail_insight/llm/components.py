"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b; bigint): component is
    the least id that links lead to.

    Large-star and small-star rounds: every id hangs its larger, then its
    smaller neighbours on its least one until nothing changes. A round is two
    joins with aggregates; a hub that a third of all links share is
    pre-aggregated and its join is dealt out by the planner's skew handling.
    Each round is cut off by a checkpoint, and the driver sees two sums.
    """
    edges = materialize(_oriented(links))
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "c")
        large = _oriented(both.join(least, F.col("a") == F.col("c")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # every id (b) of a pair hangs on its least smaller neighbour, and so do its other smaller ones
        down = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "c")
        small = large.join(down, F.col("b") == F.col("c"))
        edges = materialize(_oriented(small.select(F.col("a"), F.col("m").alias("b")).union(small.select(F.col("c").alias("a"), F.col("m").alias("b")))))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
        edges.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links with a < b."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
