"""Exact top-k search by inner product over norm buckets.

Vectors are sorted by length, longest first, and cut into buckets. A query
first searches the bucket of the longest vectors, which gives it a score that
its k-th best cannot fall below. A bucket whose longest vector cannot reach
that score is left out. For the others that score becomes a local cosine
threshold, and the bucket prunes by it in one of two ways, whichever its own
trial of thresholds says: by length, where only the bucket's head is long
enough, or by coordinates, where a row must lie within bounds on each of the
query's largest coordinates. Whatever is left is verified by exact products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retail_insight.llm.vectors import LOW, as_frame, best, blocks_of, every_cell, in_cells, integer_vectors, matrix, numbered, products, same_width
from retail_insight.session import materialize

#: Rows of a bucket, queries that meet it at a time, and products held at once.
BUCKET = 8192
PART = 2048
HELD = 1 << 21
#: Coordinates that bound a row, the thresholds that a bucket tries on so many
#: queries, and the share of its rows up to which coordinates are worth it.
FOCUS = 4
TRIED = (0.99, 0.97, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4)
TRIALS = 32
WORTH = 0.2
_SLACK = 1e-9


def feasible(q: np.ndarray, t) -> tuple[np.ndarray, np.ndarray]:
    """Bounds on a coordinate of any unit vector whose cosine with a unit
    vector is at least t, from that vector's coordinate q."""
    own, open_ = np.arccos(np.clip(q, -1, 1)), np.arccos(np.clip(t, -1, 1))
    return np.cos(np.minimum(own + open_, np.pi)) - _SLACK, np.cos(np.maximum(own - open_, 0)) + _SLACK


class Bucket:
    """Rows (longest first) and each coordinate's sorted list of them."""

    def __init__(self, rows: np.ndarray, length: np.ndarray) -> None:
        self.rows, self.length = rows, length
        self.unit = rows / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.lists = np.take_along_axis(self.unit, self.order, axis=0)

    def narrowest(self, unit: np.ndarray, t: float):
        """Of the focus coordinates: which, their bounds, and the shortest
        range of a list that they leave."""
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        lo, hi = feasible(unit[focus], t)
        ends = [(int(np.searchsorted(self.lists[:, f], a, side="left")), int(np.searchsorted(self.lists[:, f], b, side="right")))
                for f, a, b in zip(focus.tolist(), lo, hi, strict=True)]
        k = min(range(len(ends)), key=lambda i: ends[i][1] - ends[i][0])
        return focus, lo, hi, k, ends[k]

    def worth_from(self, units: np.ndarray) -> float:
        """The least threshold tried from which coordinates leave few rows."""
        some = units[np.linspace(0, len(units) - 1, min(TRIALS, len(units))).astype(int)]
        found = np.inf
        for t in TRIED:
            left = [e - s for *_, (s, e) in (self.narrowest(u, t) for u in some)]
            if np.mean(left) > WORTH * len(self.rows):
                break
            found = t
        return found

    def by_coordinates(self, unit: np.ndarray, t: float) -> np.ndarray:
        focus, lo, hi, k, (start, end) = self.narrowest(unit, t)
        at = self.order[start:end, focus[k]]
        inside = self.unit[np.ix_(at, focus)]
        return at[((inside >= lo) & (inside <= hi)).all(axis=1)]


def search_bucket(rows: np.ndarray, length: np.ndarray, key: np.ndarray, tie: np.ndarray, queries: np.ndarray, q_length: np.ndarray,
                  q_key: np.ndarray, least: np.ndarray, k: int):
    """(query, row, score) of each query's k best rows of a bucket that reach
    ``least`` (LOW: any), without the row that has the query's own key."""
    rows, queries = same_width(rows, queries)
    need = np.where(least > LOW, least.astype(float), -np.inf)
    reach = q_length * length[0]
    t = np.where(reach > 0, need / np.where(reach > 0, reach, 1), np.where(need > 0, np.inf, -np.inf))
    live = np.flatnonzero(t <= 1 + _SLACK)
    by_list = np.zeros(len(queries), dtype=bool)
    if len(rows) > HELD // BUCKET and len(live) and t[live].max() >= TRIED[-1]:
        bucket = Bucket(rows, length)
        units = queries / np.where(q_length > 0, q_length, 1)[:, None]
        high = live[t[live] >= TRIED[-1]]
        by_list[high] = t[high] >= bucket.worth_from(units[high])
    found = []
    for i in live[by_list[live]].tolist():
        at = bucket.by_coordinates(units[i], min(t[i], 1.0))
        s = products(queries[i : i + 1], rows[at])
        s[(s < least[i]) | (key[at] == q_key[i])[None, :]] = LOW
        _, col, score = best(s, tie[at], k)
        found.append((np.full(len(col), i), at[col], score))
    # by length: the bucket's head, up to the last row that is long enough
    rest = live[~by_list[live]]
    shortest = np.where(q_length[rest] > 0, need[rest] * (1 - _SLACK) / np.where(q_length[rest] > 0, q_length[rest], 1), -np.inf)
    head = np.searchsorted(-length, -shortest, side="right")
    order = np.argsort(-head, kind="stable")
    step = max(HELD // max(len(rows), 1), 1)
    for i in range(0, len(rest), step):
        some = rest[order[i : i + step]]
        n = int(head[order[i]])
        s = products(queries[some], rows[:n])
        s[(s < least[some][:, None]) | (key[None, :n] == q_key[some][:, None])] = LOW
        r, col, score = best(s, tie[:n], k)
        found.append((some[r], col, score))
    return tuple(np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in range(3))


def top_k(table: DataFrame, queries: str, k: int, id_col: str = "vec_id", vector: str = "embedding",
          bucket_rows: int = BUCKET, part_rows: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row
    for which the SQL condition ``queries`` on id holds, over all other rows.

    Components are taken as floor(256 * x). Ties go to the smaller id. Vectors
    that are null or hold null or non-finite components, and rows without id,
    take no part; a query with fewer other rows gets all of them. Rows are told
    apart as rows: a repeated one is a candidate for its twin, and is a query of
    its own. A shorter vector counts as if it ended in zeros; scores beyond 63
    bits are cut to that. An empty table gives an empty result; further columns
    are ignored whatever their names.

    A cell of at most ``bucket_rows`` rows and ``part_rows`` queries is the unit
    of work and memory; only cells that the queries' scores so far leave open
    are dealt out.
    """
    spark = table.sparkSession
    rows = numbered(integer_vectors(table, id_col, vector), [("norm", False)], bucket_rows, "at", "block")
    asked = materialize(numbered(rows.where(queries).drop("block"), [("norm", False), "at"], part_rows, "_n", "part").drop("_n"))
    blocks, parts = blocks_of(rows, "block"), blocks_of(asked, "part")

    def search(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(r) or not len(q):
            return as_frame(query=[], query_id=[], at=[], vec_id=[], score=[])
        r = r.sort_values("at")
        ids, at = r["id"].to_numpy(), r["at"].to_numpy()
        place = np.empty(len(r), dtype=np.int64)
        place[np.lexsort((at, ids))] = np.arange(len(r))
        i, j, score = search_bucket(matrix(r["v"], r["width"]), r["norm"].to_numpy(), at, place, matrix(q["v"], q["width"]),
                                    q["norm"].to_numpy(), q["at"].to_numpy(), q["least"].to_numpy(dtype=np.int64), k)
        return as_frame(query=q["at"].to_numpy()[i], query_id=q["id"].to_numpy()[i], at=at[j], vec_id=ids[j], score=score)

    schema = "query long, query_id long, at long, vec_id long, score long"
    of_query = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "at")
    first = materialize(in_cells(rows.where("block = 0"), asked.withColumn("least", F.lit(LOW)), every_cell(spark, min(blocks, 1), parts), search, schema))
    kth = first.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(F.lit(LOW)).alias("least"))
    asked = materialize(asked.join(kth.withColumnRenamed("query", "at"), "at", "left").withColumn("least", F.coalesce("least", F.lit(LOW))))
    # a part of the queries needs a bucket if one of them could reach its score with the bucket's longest vector
    reach = F.when(F.col("norm") > 0, F.col("least") * (1 - _SLACK) / F.col("norm")).when(F.col("least") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    longest = rows.where("block > 0").groupBy("block").agg(F.max("norm").alias("longest"))
    cells = (every_cell(spark, blocks, parts).join(longest, "block")
             .join(asked.groupBy("part").agg(F.min(reach).alias("reach")), "part").where("longest >= reach").select("block", "part"))
    more = in_cells(rows, asked, materialize(cells), search, schema)
    return (first.unionByName(more).withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))


QUERIES = "id % 50 = 0"
K = 5

ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.r, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS nth FROM s)
SELECT query_id, nth::INTEGER AS rank, vec_id, score FROM n WHERE nth <= {K}
"""


def op12_topk_search(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows of ``embeddings`` for every 50th id."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), QUERIES, K)
