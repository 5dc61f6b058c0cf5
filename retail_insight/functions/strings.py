"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes by default
# (str.isspace): ASCII whitespace, separators 0x1c-0x1f, NEL, NBSP and the
# Unicode space separators. Spark's trim() only removes spaces.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Strip leading and trailing whitespace like Python's ``str.strip``
    (``btrim`` over that character set: no regex per row)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(PY_WHITESPACE))


def clean_name(name: str) -> str:
    """Normalise a column name for alias matching (driver-side, schema only)."""
    return name.strip().lower().replace(" ", "").replace("_", "").replace("-", "")
