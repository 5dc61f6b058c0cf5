"""Running totals over a global order, without a one-task window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retail_insight.session import materialize


def running_total(df: DataFrame, order: list[str], value: str, out: str,
                  group: str | None = None) -> DataFrame:
    """Add ``out``: the total of ``value`` (bigint) over all rows of the same
    ``group`` up to and including this one, in ascending ``order`` (nulls
    first). Give an order without ties where the result must not depend on
    how the rows were dealt out.

    The rows are range-partitioned and sorted on (group, order), so a group
    or value that holds a third of all rows is cut into many tasks. Each task
    adds up its own part; the parts' totals (one row per part and group that
    it touches) are turned into offsets and joined back.
    """
    keys = ([group] if group else []) + order
    schema = df.schema
    cols = list(df.columns)

    def add_up(batches):
        carry_key, carry = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            v = pdf[value].to_numpy(dtype=np.int64)
            total = np.cumsum(v)
            if group:
                g = pdf[group].to_numpy(dtype=object)
                null = pd.isna(g)
                g = np.where(null, None, g)
                change = np.concatenate([[True], [a is not b and a != b for a, b in zip(g[1:], g[:-1], strict=True)]])
                at = np.flatnonzero(change)
                before = total[at] - v[at]
                base = np.repeat(before, np.diff(np.append(at, len(v))))
                total = total - base
                same = carry_key is not None and carry_key[0] == g[0]
                first = at[1] if len(at) > 1 else len(v)
                if same:
                    total[:first] += carry
                carry_key, carry = (g[-1],), int(total[-1])
            else:
                total = total + carry
                carry = int(total[-1])
            yield pdf.assign(_part_total=total)

    ranged = df.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    summed = ranged.mapInPandas(add_up, schema=_with(schema, "_part_total"))
    parts = materialize(summed.withColumn("_part", F.spark_partition_id()))
    by = ["_part"] + ([group] if group else [])
    ends = parts.groupBy(*by).agg(F.max("_part_total").alias("_end"))
    earlier = W.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select(*[F.col(c).alias(f"_o{c}") for c in by],
                          F.coalesce(F.sum("_end").over(earlier), F.lit(0)).alias("_offset"))
    on = F.col("_part") == F.col("_o_part")
    if group:
        on = on & F.col(group).eqNullSafe(F.col(f"_o{group}"))
    return (parts.join(offsets, on)
            .select(*cols, (F.col("_part_total") + F.col("_offset")).alias(out)))


def _with(schema, name: str):
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, T.StructField(name, T.LongType())])
