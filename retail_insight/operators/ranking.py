"""Exact global row numbers without a one-partition window.

``row_number() OVER (ORDER BY v, id)`` with no ``PARTITION BY`` makes Spark
move every row into a single task. This operator gives the same numbers
with the work spread over all partitions:

1. ``repartitionByRange(v, id)`` + ``sortWithinPartitions(v, id)``: each
   partition holds one contiguous slice of the order. The unique ``id``
   tie-breaker is part of the range key, so a value shared by a third of
   the rows is still split over many partitions.
2. ``monotonically_increasing_id()`` on that sorted stream encodes
   (partition index, position in partition).
3. The result is checkpointed to the reliable checkpoint folder: range
   bounds come from a sample and the id depends on row order, so both
   must be fixed once; a lost executor then re-reads the checkpoint
   instead of re-sampling.
4. Per-partition counts (one row per partition, so at most ``p`` rows)
   are turned into starting offsets and broadcast back:
   ``rank = offset[partition] + position + 1``.

With ``partition_by`` the rank restarts per group: group columns lead the
range key, counts are kept per (partition, group) and added up inside each
group, so a group holding a third of all rows is still ranked by many tasks
and never meets in one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retail_insight.operators.selection import order_statistics
from retail_insight.session import ensure_checkpoint_dir

_POS = "__ri_pos"
_PID = "__ri_pid"
_OFF = "__ri_off"
_LOW_BITS = (1 << 33) - 1


def _sort_expr(spec) -> Column:
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, str):
        return F.col(spec).asc()
    name, ascending = spec
    return F.col(name).asc() if ascending else F.col(name).desc()


def distributed_rank(df: DataFrame, order_by: Sequence, tie_breaker: str | Sequence[str],
                     rank_col: str = "rank", total_col: str | None = None,
                     partition_by: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 1-based position in ``ORDER BY order_by, tie_breaker``.

    ``order_by`` items are column names (ascending), ``(name, ascending)``
    pairs or sort Columns; ``tie_breaker`` must make the order total (the
    customer id). ``total_col`` optionally adds the row count (per group
    when ``partition_by`` is given). Nulls sort first ascending / last
    descending, as in Spark.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ties = [tie_breaker] if isinstance(tie_breaker, str) else list(tie_breaker)
    keys = ([F.col(c).asc() for c in partition_by]
            + [_sort_expr(s) for s in order_by]
            + [F.col(c).asc() for c in ties])
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ordered = (ranged.sortWithinPartitions(*keys)
               .withColumn(_POS, F.monotonically_increasing_id())
               .checkpoint(eager=True))

    groups = list(partition_by)
    pid = F.shiftright(F.col(_POS), 33)
    local = F.col(_POS).bitwiseAND(F.lit(_LOW_BITS))
    parts = ordered.groupBy(pid.alias(_PID), *[F.col(c).alias(f"__ri_{c}") for c in groups]).agg(
        F.count(F.lit(1)).alias("__ri_n"), F.min(local).alias("__ri_lo"))
    # One row per range partition and group in it: a running sum of counts.
    own = [f"__ri_{c}" for c in groups]
    before = Window.partitionBy(*own).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        _PID, *own, "__ri_lo", F.coalesce(F.sum("__ri_n").over(before), F.lit(0)).alias(_OFF),
        F.sum("__ri_n").over(Window.partitionBy(*own)).alias("__ri_total"))
    # The join is on the range partition, with the group inside it: a group
    # that holds a third of all rows stays dealt out over its partitions.
    on = pid == F.col(_PID)
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"__ri_{c}"))
    ranked = (ordered.join(offsets if groups else F.broadcast(offsets), on, "inner")
              .withColumn(rank_col, F.col(_OFF) + local - F.col("__ri_lo") + F.lit(1)))
    if total_col:
        ranked = ranked.withColumn(total_col, F.col("__ri_total"))
    return ranked.drop(_POS, _PID, _OFF, "__ri_total", "__ri_n", "__ri_lo", *own)


def exact_quantile(df: DataFrame, value_col: str, q: float, tie_breaker: str) -> Column:
    """Exact ``q``-quantile of ``value_col`` with linear interpolation
    (pandas' default) as a literal; null where there are no values.

    The two order statistics around position ``(n - 1) * q`` are found by
    :func:`order_statistics`, without a sort of the values.
    """
    vals = df.select(value_col, tie_breaker).where(F.col(value_col).isNotNull())

    def around(n: int) -> list[int]:
        return [math.floor((n - 1) * q) + 1, math.ceil((n - 1) * q) + 1] if n else []

    n, found = order_statistics(vals, [(F.col(value_col), True)], tie_breaker, around)
    if not n:
        return F.lit(None).cast("double")
    a, b = (float(row["value"]) for row in found[0])
    t = (n - 1) * q - math.floor((n - 1) * q)
    if q == 0.5:
        return F.lit((a + b) / 2.0)       # numpy median: mean of the middle pair
    return F.lit(b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t)   # numpy's two-sided lerp
