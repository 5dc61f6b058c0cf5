"""Column-level helpers shared by the operators (all JVM-side expressions)."""

from retail_insight.functions.dates import floor_days, month_index, parse_timestamp
from retail_insight.functions.numeric import ceil_div, half_even, money_sum, to_double
from retail_insight.functions.strings import py_strip

__all__ = [
    "ceil_div", "floor_days", "half_even", "money_sum", "month_index",
    "parse_timestamp", "py_strip", "to_double",
]
