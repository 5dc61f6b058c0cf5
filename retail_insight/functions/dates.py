"""Timestamp helpers.

Day counts in the results are whole 24-hour spans (``floor(delta / 24h)``),
not calendar-day differences: the DAY field of ``b - a`` on
``timestamp_ntz`` values (a day-time interval, independent of the session
time zone and of DST) counts elapsed whole days (47h59m -> 1, where
``datediff`` says 2). It truncates toward zero, which equals the floor for
every non-negative span; callers clip negative spans anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

# Date layouts tried after ISO-8601 casting, grouped by a
# shape test so that a value is only handed to layouts it can match (a
# failed layout parse is costly; garbage skips them all). A shape admits only
# months up to 12 and days up to 31.
_DAY, _MONTH = r"(0?[1-9]|[12]\d|3[01])", r"(0?[1-9]|1[0-2])"
DATE_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}", ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")),
    (r"^\d{4}/\d{1,2}/\d{1,2}", ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd")),
    (rf"^{_MONTH}/{_DAY}/\d{{4}}", ("M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy")),
    (rf"^{_DAY}\.{_MONTH}\.\d{{4}}", ("d.M.yyyy H:mm", "d.M.yyyy")),
)

# The layouts of a column of dates, by name, in the order that
# settles ties (month before day).
COLUMN_LAYOUTS = {
    "iso": DATE_LAYOUTS[0],
    "year/month/day": DATE_LAYOUTS[1],
    "month/day/year": DATE_LAYOUTS[2],
    "day/month/year": (rf"^{_DAY}/{_MONTH}/\d{{4}}", ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy")),
    "day.month.year": (rf"^{_DAY}\.{_MONTH}\.\d{{4}}", ("d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy")),
    "day-month-year": (rf"^{_DAY}-{_MONTH}-\d{{4}}", ("d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy")),
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_days(start, end) -> Column:
    """Whole days elapsed from ``start`` to ``end`` (int), for
    ``timestamp_ntz`` inputs."""
    span = _col(end).cast("timestamp_ntz") - _col(start).cast("timestamp_ntz")
    return F.extract(F.lit("DAY"), span).cast("int")


def month_index(start_month, end_month) -> Column:
    """12 * year delta + month delta between two month starts (int)."""
    s, e = _col(start_month), _col(end_month)
    return ((F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))).cast("int")


def _tries(s: Column, shape: str, fmts) -> list[Column]:
    """The value by each layout that has as many colons as it: no other can
    read it, and a failed parse costs many times the test."""
    return [F.when(s.rlike(shape + "[^:]*" + ":[^:]*" * fmt.count(":") + "$"), F.try_to_timestamp(s, F.lit(fmt))).cast("timestamp_ntz") for fmt in fmts]


def parse_timestamp(c, dtype=None, layouts=DATE_LAYOUTS) -> Column:
    """Coerce a column to ``timestamp_ntz``; unparsable values become null.

    ``dtype`` is the column's Spark type when known (from ``df.schema``): a
    timestamp or date column is only re-typed, strings go through ISO casting
    and then the layouts whose shape test they pass.
    """
    c = _col(c)
    if isinstance(dtype, TimestampNTZType):
        return c
    if isinstance(dtype, (TimestampType, DateType)):
        return c.cast("timestamp_ntz")
    s = c if (dtype is None or isinstance(dtype, StringType)) else c.cast("string")
    s = F.trim(s)
    tries = [s.try_cast("timestamp_ntz")]
    for shape, fmts in layouts:
        tries += _tries(s, shape, fmts)
    return F.coalesce(*tries)


def parse_in_layout(c, layout: str) -> Column:
    """Values of one of COLUMN_LAYOUTS as ``timestamp_ntz``; others are null."""
    s = F.trim(_col(c).cast("string"))
    shape, fmts = COLUMN_LAYOUTS[layout]
    tries = [F.when(s.rlike(shape), s.try_cast("timestamp_ntz"))] if layout == "iso" else []
    return F.coalesce(*tries, *_tries(s, shape, fmts))


def elect_layout(df: DataFrame, column: str) -> str | None:
    """The layout that most values of a column of dates have, for all of them.

    One aggregate counts, for each of COLUMN_LAYOUTS, the values that it can
    read. The most readable layout wins; where day and month may change places
    in every value (no day after the 12th) the counts tie, and the earlier name,
    month before day, is taken. None if ``column`` is not text.
    """
    if not isinstance(df.schema[column].dataType, StringType):
        return None
    c = F.col(f"`{column}`")
    row = df.agg(*[F.count(parse_in_layout(c, name)).alias(f"n{i}") for i, name in enumerate(COLUMN_LAYOUTS)]).first()
    return max(enumerate(COLUMN_LAYOUTS), key=lambda x: (row[x[0]], -x[0]))[1]
