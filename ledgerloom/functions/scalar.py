"""Column expressions for the reference's scalar rules.

All of these are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def as_date_col(value) -> Column:
    """A report day given as Column, ``date`` or ISO text."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.date()
    if isinstance(value, _dt.date):
        return F.lit(value)
    return F.lit(str(value)).cast("date")


def as_ts_col(value) -> Column:
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, (_dt.datetime, _dt.date)):
        return F.lit(value).cast("timestamp")
    return F.lit(str(value)).cast("timestamp")


def check_days(days) -> int:
    """The trailing window length must be a non-negative integer."""
    if isinstance(days, bool) or not isinstance(days, int) or days < 0:
        raise ValueError(f"days must be an integer >= 0, got {days!r}")
    return days


def trailing_days(col: Column | str, as_of, days: int) -> Column:
    """``col >= as_of - days`` (inclusive, no upper bound: n+1 calendar days, future rows pass)."""
    c = F.col(col) if isinstance(col, str) else col
    return c >= F.date_sub(as_date_col(as_of), check_days(days))


def stock_status(current: Column, minimum: Column, maximum: Column,
                 low: str = "low", high: str = "high", normal: str = "normal") -> Column:
    """Low if current <= min, else high if current >= max, else normal.

    A null bound makes its comparison null, which falls through, so a null
    min can still be 'high' and nulls on both sides give 'normal'.
    """
    return F.when(current <= minimum, low).when(current >= maximum, high).otherwise(normal)


def exact_sum(col: Column | str) -> Column:
    """Money sum computed exactly in decimal, returned as double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(MONEY)).cast("double")


def int_sum(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c).cast("bigint")


def exact_avg(col: Column | str) -> Column:
    """Average as exact decimal sum / non-null count; null on no rows."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_divide(F.sum(c.cast(MONEY)).cast("double"), F.count(c).cast("double"))


def blank_to_null(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.trim(c) == "", F.lit(None)).otherwise(c)


def falsy_default(col: Column | str, default) -> Column:
    """JavaScript ``x || default`` on text input: null and '' take the default."""
    c = F.col(col) if isinstance(col, str) else col
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == ""), d).otherwise(c)


def numeric_prefix_int(col: Column | str) -> Column:
    """``parseInt``: the leading integer of the text ('12abc' -> 12, '12.7' -> 12, 'abc' -> null)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(F.trim(c), r"^[+-]?[0-9]+", 0).try_cast("int")


def numeric_prefix_float(col: Column | str) -> Column:
    """``parseFloat``: the leading decimal number of the text, else null."""
    c = F.col(col) if isinstance(col, str) else col
    pattern = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
    return F.regexp_extract(F.trim(c), pattern, 0).try_cast("double")


def hours_ago(now: Column, ts: Column | str) -> Column:
    """``floor((now_ms - ts_ms) / 3600000)`` on timestamps (negative for future rows)."""
    t = F.col(ts) if isinstance(ts, str) else ts
    diff = F.unix_micros(now.cast("timestamp")) - F.unix_micros(t.cast("timestamp"))
    return F.floor(diff / F.lit(3_600_000_000)).cast("int")


def mean_of_three(a: Column, b: Column, c: Column) -> Column:
    """overall rating, null when any part is null."""
    return (a + b + c) / F.lit(3.0)


def markup_price(cost: Column) -> Column:
    """selling price from cost: ``cost * 1.3`` when cost > 0, else 0."""
    return F.when(cost > 0, (cost.cast(MONEY) * F.lit(1.3).cast("decimal(2,1)")).cast(MONEY)).otherwise(
        F.lit(0).cast(MONEY))
