"""Exact order statistics of several features at once, without a sort.

Which row stands at rank r when rows are ordered by (value, id)? All wanted
ranks of all features are narrowed down together:

1. one aggregate gives, for every bracket that still holds a wanted rank, a
   quantile sketch (``percentile_approx``, merged from partial ones) and with
   it a value near the rank and bounds around it;
2. one aggregate counts the bracket's rows below, at, between and above them,
   exactly; the part that holds the rank is the next bracket, which is a few
   ten-thousandths of the old one;
3. a value that many rows share is left behind as a fixed prefix, and the same
   goes on with the id, six bytes at a time;
4. brackets of at most ``ENOUGH`` rows are read and sorted.

Nothing but counts, sketches and those few rows leaves a task. Bounds come
from a sketch, but what they are used for is counted, so a poor sketch costs a
round and never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENOUGH = 2000
ACCURACY = 10_000
_BYTES = 6   # as a whole number, exact in a sketch of doubles


def oriented(value: Column, ascending: bool) -> Column:
    """A double that ascends in the order; nulls come first ascending and last
    descending, as in Spark's sorts."""
    v = value.cast("double")
    return F.coalesce(v, F.lit(float("-inf"))) if ascending else F.coalesce(-v, F.lit(float("inf")))


def _id_part(id_col: str, nth: int) -> Column:
    """The nth six bytes of the id as a whole number; ids of other types
    order as their text."""
    raw = F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8")
    return F.conv(F.rpad(F.hex(F.substring(raw, _BYTES * nth + 1, _BYTES)), 2 * _BYTES, "0"), 16, 10).cast("bigint")


class _Wanted:
    """A rank that is looked for among the rows of a bracket."""

    def __init__(self, feature: int, nth: int, rank: int, size: int) -> None:
        self.feature, self.nth, self.rank, self.size = feature, nth, rank, size
        self.level, self.path = 0, ()   # key part in hand; conditions (level, sign, number) that make the bracket

    @property
    def bracket(self):
        return self.feature, self.level, self.path


def order_statistics(df: DataFrame, features: Sequence[tuple[Column, bool]], id_col: str,
                     ranks: Callable[[int], Sequence[int]]) -> tuple[int, list[list]]:
    """(n, found): ``found[f][i]`` is the row (key, id, value) at the i-th of
    ``ranks(n)`` (from 1) of feature f, an (expression, ascending) pair, with
    ties in the value by id ascending. ``df`` is read a few times: hand over a
    materialised or cheap frame. ``id_col`` should be unique."""
    n = df.count()
    wanted = [_Wanted(f, i, r, n) for f in range(len(features)) for i, r in enumerate(ranks(n)) if 1 <= r <= n]
    keys = [oriented(v, asc) for v, asc in features]

    def part(feature: int, level: int) -> Column:
        return keys[feature] if level == 0 else _id_part(id_col, level - 1)

    def inside(w: _Wanted) -> Column:
        cond = F.lit(True)
        for level, sign, x in w.path:
            c, x = part(w.feature, level), F.lit(x)
            cond = cond & {"<": c < x, "<=": c <= x, "=": c == x, ">=": c >= x, ">": c > x}[sign]
        return cond

    open_ = [w for w in wanted if w.size > ENOUGH]
    while open_:
        brackets: dict = {}
        for w in open_:
            brackets.setdefault(w.bracket, []).append(w)
        sketches = []
        for ws in brackets.values():
            at = [min(max(w.rank / w.size + d / ACCURACY, 0.0), 1.0) for w in ws for d in (-2, 0, 2)]
            sketches.append(F.percentile_approx(F.when(inside(ws[0]), part(ws[0].feature, ws[0].level)), at, ACCURACY))
        near = df.agg(*[s.alias(f"b{k}") for k, s in enumerate(sketches)]).first()
        bounds = [(w, *near[k][3 * i : 3 * i + 3]) for k, ws in enumerate(brackets.values()) for i, w in enumerate(ws)]
        counts = []
        for k, (w, lo, mid, hi) in enumerate(bounds):
            c, own = part(w.feature, w.level), inside(w)
            for j, cond in enumerate((c < lo, (c >= lo) & (c < mid), c == mid, (c > mid) & (c <= hi))):
                counts.append(F.count_if(own & cond).alias(f"c{k}_{j}"))
        seen = df.agg(*counts).first()
        for k, (w, lo, mid, hi) in enumerate(bounds):
            steps = ((("<", lo),), ((">=", lo), ("<", mid)), (("=", mid),), ((">", mid), ("<=", hi)), ((">", hi),))
            sizes = [seen[f"c{k}_{j}"] for j in range(4)]
            sizes.append(w.size - sum(sizes))
            j = 0
            while w.rank > sizes[j]:
                w.rank -= sizes[j]
                j += 1
            w.path += tuple((w.level, sign, x) for sign, x in steps[j])
            w.size, w.level = sizes[j], w.level + (j == 2)
        # ids that agree to their end are one id: any of its rows will do
        longest = _BYTES * max((w.level - 1 for w in open_), default=0)
        if longest > 0 and not df.where(F.octet_length(F.col(f"`{id_col}`").cast("string")) > longest).limit(1).count():
            for w in open_:
                if _BYTES * (w.level - 1) >= longest:
                    w.rank, w.size = 1, 0
        open_ = [w for w in open_ if w.size > ENOUGH]

    found: list[list] = [[None] * len(ranks(n)) for _ in features]
    brackets = {}
    for w in wanted:
        brackets.setdefault((*w.bracket, w.size), []).append(w)
    if not brackets:
        return n, found
    lists = []
    for k, ws in enumerate(brackets.values()):
        row = F.struct(keys[ws[0].feature].alias("key"), F.col(f"`{id_col}`").alias("id"), features[ws[0].feature][0].alias("value"))
        few = F.when(inside(ws[0]), row)
        lists.append((F.sort_array(F.collect_list(few)) if ws[0].size else F.array(F.min(few))).alias(f"b{k}"))
    got = df.agg(*lists).first()
    for k, ws in enumerate(brackets.values()):
        for w in ws:
            found[w.feature][w.nth] = got[k][w.rank - 1]
    return n, found
