"""Integer vectors in bounded cells of rows and queries, and exact products.

A search of many queries over many rows is dealt out as cells: a bounded
block of rows meets a bounded block of queries. Rows and queries carry their
components as bytes of the narrowest whole-number type.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.operators.ranking import distributed_rank

SCALE = 256
#: Stands for "no score"; every score is greater.
LOW = np.iinfo(np.int64).min
_LIMIT = float(1 << 62)
_WIDTHS = ((2, np.int16), (4, np.int32), (8, np.int64))


def integer_vectors(table: DataFrame, id_col: str, vector: str, further: dict | None = None, scale: int = SCALE) -> DataFrame:
    """id (bigint), the ``further`` columns (name to Column), v (bytes), width
    (bytes of a component), norm (double) of every row whose id and vector are
    not null and whose components are all finite: each component x becomes
    floor(scale * x), x as double (cut to 62 bits)."""
    x = F.col(f"`{vector}`")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    further = further or {}
    rows = table.where(F.col(f"`{id_col}`").isNotNull() & x.isNotNull() & ok).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), *[c.alias(n) for n, c in further.items()], x.alias("_x"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def pack(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            many = np.array([len(v) for v in pdf["_x"]], dtype=np.int64)
            flat = np.concatenate([np.asarray(v, dtype=np.float64) for v in pdf["_x"]])
            whole = np.clip(np.floor(scale * flat), -_LIMIT, _LIMIT).astype(np.int64)
            most = int(np.abs(whole).max()) if len(whole) else 0
            width, kind = next(w for w in _WIDTHS if most <= np.iinfo(w[1]).max)
            data, cut = whole.astype(kind).tobytes(), np.concatenate([[0], np.cumsum(many)])
            squares = np.concatenate([[0.0], np.cumsum(whole.astype(float) ** 2)])
            out = pdf.drop(columns="_x")
            out["v"] = [data[i * width : j * width] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            out["width"] = width
            # a sum of its own for each vector: differences of a running sum would lose digits
            out["norm"] = np.sqrt(np.add.reduceat(np.append(squares[1:] - squares[:-1], 0.0), cut[:-1]) * (many > 0))
            yield out

    return rows.mapInPandas(pack, schema=f"{kinds}v binary, width int, norm double")


def matrix(v, width) -> np.ndarray:
    """The vectors as rows of an int64 matrix, shorter ones ended with zeros."""
    kinds = dict(_WIDTHS)
    v, width = list(v), list(width)
    if not v:
        return np.zeros((0, 0), dtype=np.int64)
    if len(set(width)) == 1 and len(set(map(len, v))) == 1:
        return np.frombuffer(b"".join(v), dtype=kinds[width[0]]).reshape(len(v), -1).astype(np.int64)
    parts = [np.frombuffer(x, dtype=kinds[w]) for x, w in zip(v, width, strict=True)]
    out = np.zeros((len(v), max(map(len, parts))), dtype=np.int64)
    for row, p in zip(out, parts, strict=True):
        row[: len(p)] = p
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def small(a: np.ndarray, b: np.ndarray) -> bool:
    """Every sum of products is exact in double precision."""
    if not a.size or not b.size:
        return True
    return float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all of b; beyond 63 bits
    they are cut to that."""
    if small(a, b):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LOW + 1, -LOW - 1).astype(np.int64)


def best(scores: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of each row's k highest scores other than LOW, ties
    by the least ``tie`` of the column (unless scores has its own, as a matrix)."""
    m, n = scores.shape
    if not m or not n:
        return (np.empty(0, dtype=np.int64),) * 3
    kth = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(m, LOW)
    row, col = np.nonzero((scores >= kth[:, None]) & (scores > LOW))
    found, by = scores[row, col], tie[row, col] if tie.ndim == 2 else tie[col]
    order = np.lexsort((by, -found, row))
    row, col, found = row[order], col[order], found[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[nth < k], col[nth < k], found[nth < k]


def numbered(rows: DataFrame, order: list, size: int, number: str, block: str) -> DataFrame:
    """Add ``number`` (from 1, in the given order, told apart by id) and
    ``block``: runs of ``size`` rows of that order."""
    ranked = distributed_rank(rows, order, "id", rank_col=number)
    return ranked.withColumn(number, F.col(number).cast("long")).withColumn(block, F.floor((F.col(number) - 1) / size).cast("long"))


def in_cells(rows: DataFrame, queries: DataFrame, cells: DataFrame, search, schema: str) -> DataFrame:
    """search(rows, queries), as pandas frames, for each cell (block, part):
    the rows of that block with the queries of that part. Both are bounded, so
    a cell is, and every cell is a unit of work of its own."""
    r, q = rows.join(cells, "block"), queries.join(cells, "part")
    q = q.select(*[F.col(c).alias(c) for c in q.columns])  # the queries are some of the rows: columns of their own
    return r.groupBy("block", "part").cogroup(q.groupBy("block", "part")).applyInPandas(search, schema=schema)


def blocks_of(table: DataFrame, column: str) -> int:
    """The number of blocks (0 if there are no rows)."""
    last = table.agg(F.max(column)).first()[0]
    return 0 if last is None else int(last) + 1


def every_cell(spark, blocks: int, parts: int) -> DataFrame:
    """(block, part): each block of rows with each part of the queries."""
    return spark.range(blocks).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(parts, 1) - 1).cast("long"))).alias("part")).where(
        F.lit(parts > 0))


def as_frame(**columns) -> pd.DataFrame:
    return pd.DataFrame({k: np.asarray(v) for k, v in columns.items()})
