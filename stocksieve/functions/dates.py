"""Date expressions; every "today" in the pipeline is an explicit ``as_of``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _c


def as_date(as_of: str | _dt.date | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def parse_day_month_year(s: ColumnOrName) -> Column:
    """``'5 Dec 2024'`` / ``'05 Dec 2024'`` -> date; bad text -> null."""
    return F.try_to_date(_c(s), "d MMM yyyy")


def home_filing_date(s: ColumnOrName, as_of, roll_year: bool = False) -> Column:
    """Listing dates come as ``'5 Dec'`` or ``'Today'``.  ``Today`` becomes
    the run day, then the run year is appended.  With ``roll_year`` a date
    that would lie after ``as_of`` (a December row read in January) is
    moved back one year; the default keeps the plain run-year reading."""
    day = as_date(as_of)
    text = F.replace(_c(s), F.lit("Today"), F.date_format(day, "dd MMM"))
    parsed = F.try_to_date(F.concat(text, F.lit(" "), F.year(day).cast("string")), "d MMM yyyy")
    if roll_year:
        parsed = F.when(parsed > day, F.add_months(parsed, -12)).otherwise(parsed)
    return parsed


def days_before(as_of, n: int) -> Column:
    """``CURRENT_DATE - n`` for a fixed ``as_of``."""
    return F.date_sub(as_date(as_of), n)


def text_date(s: ColumnOrName) -> Column:
    """Lenient text -> date cast (``2024-08-14`` or ``2024-08-14 00:00:00``)."""
    c = _c(s)
    return F.coalesce(c.try_cast("date"), c.try_cast("timestamp").cast("date"))
