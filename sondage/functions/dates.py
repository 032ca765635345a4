"""Calendar arithmetic on columns of times without a zone, read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def months_later(t: Column, n: Column) -> Column:
    """The same day and time n months on; days beyond a month's end run into the next month."""
    t = t.cast("timestamp_ntz")
    first = F.add_months(F.trunc(t, "month"), n).cast("timestamp_ntz")
    return first + F.make_dt_interval(days=F.dayofmonth(t) - 1) + (t - F.date_trunc("day", t).cast("timestamp_ntz"))


def year_bounds(year: Column) -> tuple[Column, Column]:
    """The first moment of a year and of the next."""
    return tuple(F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) for y in (year, year + 1))


def month_bounds(year: Column, month: Column) -> tuple[Column, Column]:
    """The first moment of a month (1 and on; those beyond 12 are of later years) and of the next."""
    low = months_later(year_bounds(year)[0], month - 1)
    return low, months_later(low, F.lit(1))
