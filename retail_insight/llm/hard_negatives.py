"""Hard negatives by the threshold algorithm over sorted lists.

Rows lie in bounded blocks. A block has one list for each dimension, sorted by
that component; an anchor reads it from the end that its own component's sign
favours. Rows met so far are scored exactly; no other row of the block can
score more than the sum of the anchor's products with the components read
last. Reading ends where that sum falls strictly below what each of the
anchor's windows still needs: its k-th best score, or its lower end while it
has fewer. Blocks' findings are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retail_insight.llm.vectors import LOW, as_frame, best, blocks_of, every_cell, in_cells, integer_vectors, matrix, numbered, products, same_width, small
from retail_insight.session import materialize

BLOCK = 8192
PART = 1024
#: Numbers held at once, the first depth to which lists are read, and the share
#: of a block beyond which the rest is read to its end in one go.
HELD = 1 << 21
DEPTH = 8
REST = 0.5
HIGH = -LOW - 1


class Lists:
    """Each dimension's rows in ascending order of their component."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)

    def limits(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """What a row that no list has shown down to ``depth`` can score."""
        top, bottom = self.values[len(self.values) - depth], self.values[depth - 1]
        return np.where(anchors > 0, anchors * top, anchors * bottom).sum(axis=1)

    def read(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """Rows that each anchor meets down to ``depth``, lists one by one."""
        top, bottom = self.order[len(self.order) - depth :].T, self.order[:depth].T
        return np.where((anchors > 0)[:, :, None], top[None], bottom[None]).reshape(len(anchors), -1)


def _windows(scores: np.ndarray, fits: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.where(fits & (scores >= lo[:, None]) & (scores <= hi[:, None]), scores, LOW)


def search_block(rows: np.ndarray, key: np.ndarray, label: np.ndarray, tie: np.ndarray, anchors: np.ndarray, a_key: np.ndarray,
                 a_label: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int):
    """(anchor, window, row, score): of each anchor's windows (columns of lo
    and hi, both ends in; empty if lo > hi) the k best rows of the block, of
    the anchor's label but itself (``same``) or of other labels."""
    rows, anchors = same_width(rows, anchors)
    n, d = rows.shape
    found = [(np.empty(0, dtype=np.int64),) * 4]

    def eligible(which, at=None):
        l, own = (label[None, :], key[None, :]) if at is None else (label[at], key[at])
        return (l == a_label[which][:, None]) & (own != a_key[which][:, None]) if same else l != a_label[which][:, None]

    def keep(which, w, got, at=None):
        r, col, score = got
        found.append((which[r], np.full(len(r), w), col if at is None else at[r, col], score))

    def to_the_end(which):
        step = max(HELD // n, 1)
        for i in range(0, len(which), step):
            some = which[i : i + step]
            scores, fits = products(anchors[some], rows), eligible(some)
            for w in range(lo.shape[1]):
                keep(some, w, best(_windows(scores, fits, lo[some, w], hi[some, w]), tie, k))

    active, depth = np.flatnonzero((lo <= hi).any(axis=1)), DEPTH
    exact = small(anchors, rows)
    lists = Lists(rows) if exact and depth * d < REST * n and len(active) else None
    while len(active):
        if lists is None or depth * d >= REST * n:
            to_the_end(active)
            break
        going = []
        step = max(HELD // (depth * d * max(d, 1)), 1)
        for i in range(0, len(active), step):
            some = active[i : i + step]
            at = np.sort(lists.read(anchors[some], depth), axis=1)
            fresh = np.ones(at.shape, dtype=bool)
            fresh[:, 1:] = at[:, 1:] != at[:, :-1]
            scores = np.einsum("mld,md->ml", rows[at].astype(float), anchors[some].astype(float)).astype(np.int64)
            fits, limit = fresh & eligible(some, at), lists.limits(anchors[some], depth)
            done, got = np.ones(len(some), dtype=bool), []
            for w in range(lo.shape[1]):
                a, b = lo[some, w], hi[some, w]
                inside = _windows(scores, fits, a, b)
                kth = np.partition(inside, inside.shape[1] - k, axis=1)[:, inside.shape[1] - k] if inside.shape[1] >= k else np.full(len(some), LOW)
                done &= (limit < np.where(kth > LOW, kth, a)) | (a > b)
                got.append(inside)
            for w, inside in enumerate(got):
                inside[~done] = LOW
                keep(some, w, best(inside, tie[at], k), at)
            going.append(some[~done])
        active, depth = np.concatenate(going), 4 * depth
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _share(score, percent: int, up: bool) -> int:
    """The least (up) or greatest whole s with 100 * s on that side of percent * score."""
    x = percent * int(score)
    return -(-x // 100) if up else x // 100


def mine(table: DataFrame, anchors: str, label, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
         id_col: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK, part_rows: int = PART) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for each anchor (the SQL condition ``anchors`` on id) and
    each of its ``positives`` best other rows of its label (the Column
    ``label``), the ``negatives`` best rows of other labels whose score is at
    least ``least`` and at most ``most`` percent of the positive's.

    A score is the inner product of vectors as floor(256 * x); higher ones come
    first, ties by the smaller id. Rows without id or label, with a null vector
    or null or non-finite components take no part. With fewer positives or
    negatives all of them count; an anchor without any gives no rows; a positive
    with a negative score has an empty window. Rows are told apart as rows: a
    repeated row is another row, and an anchor of its own. Shorter vectors end
    in zeros, scores beyond 63 bits are cut to that. An empty table gives an
    empty result; further columns are ignored whatever their names.

    A cell of at most ``block_rows`` rows and ``part_rows`` anchors is the unit
    of work and memory, also where most rows have one label or one vector.
    """
    spark = table.sparkSession
    valid = integer_vectors(table, id_col, vector, {"label": label.cast("long")}).where("label is not null")
    rows = numbered(valid, [], block_rows, "at", "block")
    asked = materialize(numbered(rows.where(anchors).drop("block"), ["at"], part_rows, "_n", "part").drop("_n"))
    cells = materialize(every_cell(spark, blocks_of(rows, "block"), blocks_of(asked, "part")))

    def search(windows, same: bool, k: int):
        def of(r: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(r) or not len(q):
                return as_frame(anchor=[], slot=[], at=[], id=[], score=[])
            ids, at = r["id"].to_numpy(), r["at"].to_numpy()
            place = np.empty(len(r), dtype=np.int64)
            place[np.lexsort((at, ids))] = np.arange(len(r))
            lo, hi = windows(q)
            i, w, j, score = search_block(matrix(r["v"], r["width"]), at, r["label"].to_numpy(), place, matrix(q["v"], q["width"]),
                                          q["at"].to_numpy(), q["label"].to_numpy(), lo, hi, same, k)
            return as_frame(anchor=q["at"].to_numpy()[i], slot=w, at=at[j], id=ids[j], score=score)

        return of

    def any_score(q):
        return np.full((len(q), 1), LOW + 1), np.full((len(q), 1), HIGH)

    def of_positives(q):
        lo, hi = np.ones((len(q), positives), dtype=np.int64), np.zeros((len(q), positives), dtype=np.int64)
        for i, scores in enumerate(q["p_scores"]):
            for w, p in enumerate(scores):
                lo[i, w], hi[i, w] = (min(max(_share(p, c, up), LOW + 1), HIGH) for c, up in ((least, True), (most, False)))
        return lo, hi

    schema = "anchor long, slot long, at long, id long, score long"
    first = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "at")

    def merged(df: DataFrame, k: int) -> DataFrame:
        return df.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k)

    near = merged(in_cells(rows, asked, cells, search(any_score, True, positives), schema), positives)
    near = materialize(near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "id", "score"))).alias("p")))
    asked = materialize(asked.join(near.select(F.col("anchor").alias("at"), F.col("p.id").alias("p_ids"), F.col("p.score").alias("p_scores")), "at"))
    far = merged(in_cells(rows, asked, cells, search(of_positives, False, negatives), schema), negatives)
    slots = asked.select(F.col("at").alias("anchor"), F.col("id").alias("anchor_id"), F.posexplode(F.arrays_zip("p_ids", "p_scores")).alias("slot", "p"))
    return far.join(slots.withColumn("slot", F.col("slot").cast("long")), ["anchor", "slot"]).select(
        "anchor_id", F.col("p.p_ids").alias("positive_id"), F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("p.p_scores").alias("positive_score"), F.col("score").alias("negative_score"))


ANCHORS = "id % 100 = 0"

ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS nth FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.nth ORDER BY s.score DESC, s.vec_id, s.r) AS nth
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE p.nth <= 5)
SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE nth <= 10
"""


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives for every 100th id of ``embeddings``; every 7th id first
    takes the next label."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ANCHORS, label)
