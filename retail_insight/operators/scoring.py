"""Rank-quantile scores (1..q) for recency, frequency, monetary, tenure.

The score of a customer is the quantile bin of its *unique* rank, with ties
in the value broken by customer id ascending (recency ranks descending,
ties still by id ascending). For ``n >= q`` rows and 1-based rank ``r`` the
equal-frequency bin is

    score = max(1, ceil((r - 1) * q / (n - 1)))

computed in integers. This is not ``ntile``: the two disagree whenever
``n mod q`` is not 0 or 1. Fewer than ``q`` customers all get score ``q``.
For the customer table no row is ranked at all: the q - 1 rows at which one
bin ends and the next begins are found for all features together
(:func:`order_statistics`), and a customer's score is the number of those
cut points, (value, id) pairs, that lie before it, plus 1: a plain expression
over the table, without a sort, shuffle or join. :func:`rank_quantile` gives
the same bins from explicit ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_insight.functions.numeric import ceil_div, half_even
from retail_insight.operators.ranking import distributed_rank
from retail_insight.operators.selection import order_statistics, oriented

# Fixed values: (value column, ascending rank, score column).
RFMT_SPECS = (
    ("Recency", False, "R_Score"),
    ("Frequency", True, "F_Score"),
    ("Monetary", True, "M_Score"),
    ("Tenure", True, "T_Score"),
)
RFM_SPECS = RFMT_SPECS[:3]


def rank_quantile(df: DataFrame, value_col: str, ascending: bool, out_col: str,
                  q: int = 5, id_col: str = "CustomerID") -> DataFrame:
    """Add ``out_col`` = equal-frequency bin (1..q) of the unique rank."""
    ranked = distributed_rank(df, [(value_col, ascending)], id_col,
                              rank_col="__rq_r", total_col="__rq_n")
    r, n = F.col("__rq_r"), F.col("__rq_n")
    binned = F.greatest(F.lit(1), ceil_div((r - F.lit(1)) * F.lit(q), F.greatest(n - F.lit(1), F.lit(1))))
    score = F.when(n < F.lit(q), F.lit(q)).otherwise(binned).cast("int")
    return ranked.withColumn(out_col, score).drop("__rq_r", "__rq_n")


def scores_by_id(customers: DataFrame, specs, q: int, id_col: str) -> DataFrame:
    """Attach one score column per spec; ``id_col`` must be unique (the
    customer table's key). The table is read a few times to find the cut
    points: hand over a materialised one."""
    def last_of_bins(n: int) -> list[int]:
        return [s * (n - 1) // q + 1 for s in range(1, q)] if n >= q else []

    n, cuts = order_statistics(customers, [(F.col(c), asc) for c, asc, _ in specs], id_col, last_of_bins)
    scores = {}
    for (value, asc, out), ends in zip(specs, cuts, strict=True):
        score, key = F.lit(q if n < q else 1), oriented(F.col(value), asc)
        for end in ends:
            beyond = (key > end["key"]) | ((key == end["key"]) & (F.col(id_col) > F.lit(end["id"])))
            score = score + beyond.cast("int")
        scores[out] = score.cast("int")
    return customers.withColumns(scores)


def calculate_rfmt_scores(customers: DataFrame, q: int = 5, id_col: str = "CustomerID") -> DataFrame:
    """R/F/M/T scores, ``RFM_Score`` (digits of R, F, M) and ``RFMT_Mean``
    (mean of the four scores, 2 dp)."""
    out = scores_by_id(customers, RFMT_SPECS, q, id_col)
    return out.withColumns({
        "RFM_Score": F.concat(*[F.col(c).cast("string") for c in ("R_Score", "F_Score", "M_Score")]),
        "RFMT_Mean": half_even((F.col("R_Score") + F.col("F_Score") + F.col("M_Score")
                                + F.col("T_Score")) / F.lit(4.0), 2),
    })


def calculate_rfm_scores_legacy(customers: DataFrame, q: int = 4, id_col: str = "CustomerID") -> DataFrame:
    """Five-segment variant: R/F/M quartiles, ``RFM_Score``, ``RFM_Mean``."""
    out = scores_by_id(customers, RFM_SPECS, q, id_col)
    return out.withColumns({
        "RFM_Score": F.concat(*[F.col(c).cast("string") for c in ("R_Score", "F_Score", "M_Score")]),
        "RFM_Mean": half_even((F.col("R_Score") + F.col("F_Score") + F.col("M_Score")) / F.lit(3.0), 2),
    })
