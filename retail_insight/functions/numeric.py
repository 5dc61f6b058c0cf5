"""Numeric helpers with the rounding and summation rules the results need.

* ``half_even(x, n)`` is ``rint(x * 10^n) / 10^n``: the same arithmetic as
  numpy's ``round`` (and DuckDB's ``round_even``). Spark's ``round`` is
  half-up and ``bround`` rounds the decimal expansion, and both disagree
  with it on ordinary money values, so they are not used for outputs.
* ``money_sum`` adds amounts as whole micro-units in a decimal: exact,
  independent of shuffle order, with room for 10^32 units of money.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_even(c, n: int) -> Column:
    """Round half to even at ``n`` decimals, the numpy way."""
    scale = float(10 ** n)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def micros(c) -> Column:
    """Whole micro-units as a decimal: the long cast is quick and covers
    ordinary amounts, the decimal one everything else."""
    whole = F.rint(_col(c) * F.lit(float(MICRO)))
    return F.coalesce(whole.try_cast("bigint").cast("decimal(28,0)"), whole.cast("decimal(28,0)"))


def from_micros(c) -> Column:
    """Micro-units back as a double."""
    return _col(c).cast("double") / F.lit(float(MICRO))


def money_sum(c) -> Column:
    """Exact, order-independent sum of a money column, returned as double."""
    return from_micros(F.sum(micros(c)))


def ceil_div(num, den) -> Column:
    """Ceiling of ``num / den`` for non-negative integers, kept integral."""
    num, den = _col(num), _col(den)
    return F.floor((num + den - F.lit(1)) / den).cast("bigint")


def to_double(c) -> Column:
    """``pd.to_numeric(errors='coerce')``: unparsable values become null."""
    return _col(c).try_cast("double")
