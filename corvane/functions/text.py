"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blanks around keys and names.
BLANKS = " \t\n\r\x0b\x0c 　"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: Column | str) -> Column:
    """Key without outer blanks, in lower case; blank keys become null."""
    key = F.lower(F.btrim(col(c), F.lit(BLANKS)))
    return F.when(key != "", key)


def instant(c: Column | str) -> Column:
    """ISO spellings of an instant as a timestamp. Without a zone the value is UTC; blank or unreadable gives null."""
    raw = F.upper(F.btrim(col(c), F.lit(BLANKS)))
    day = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zoned = F.when(day, F.concat(raw, F.lit("T00:00:00Z"))).when(raw.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), raw).otherwise(F.concat(raw, F.lit("Z")))
    # ±hhmm is read as ±hh:mm
    return F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def js_round(c: Column, digits: int) -> Column:
    """Half-up rounding by floor(x * 10^d + 0.5), which is stable across engines."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits
