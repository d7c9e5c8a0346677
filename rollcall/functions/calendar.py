"""Month and age arithmetic.

``recency_filter`` and ``age_between`` are written as plain date ranges on the stored column. They keep
the same rows as testing the computed number of months or years, but a range reaches the Parquet scan.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.params import Month

DAYS_PER_YEAR = 365


def _as_of(as_of: date | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def month_to_date(yyyymm: Column) -> Column:
    """First day of a YYYYMM month."""
    return F.to_date((yyyymm * 100 + 1).cast("string"), "yyyyMMdd")


def absolute_month(day: Column) -> Column:
    """YEAR*12 + MONTH of a date."""
    return F.year(day) * 12 + F.month(day)


def shift_month(yyyymm: Column, months: int) -> Column:
    """YYYYMM moved by a number of months."""
    moved = F.add_months(month_to_date(yyyymm), months)
    return F.year(moved) * 100 + F.month(moved)


def months_since(day: Column, anomes: int) -> Column:
    """Calendar months from ``day`` to the reference month; negative after it, NULL for NULL."""
    return F.lit(Month(anomes).absolute) - absolute_month(day)


def recency_filter(day: Column, anomes: int, lo: int | None, hi: int) -> Column:
    """``lo <= months_since(day) <= hi`` as a date range; no lower bound when ``lo`` is None."""
    ref = Month(anomes)
    test = day >= F.lit(ref.plus(-hi).first_day)
    if lo is not None:
        test = test & (day <= F.lit(ref.plus(-lo).last_day))
    return test


def age_years(born: Column, as_of: date | Column | None = None, exact: bool = False) -> Column:
    """Age in whole 365-day years, cut toward zero. ``exact`` counts calendar years instead."""
    today = _as_of(as_of)
    if exact:
        return F.floor(F.months_between(today, born) / 12).cast("int")
    return F.call_function("div", F.datediff(today, born), F.lit(DAYS_PER_YEAR)).cast("int")


def age_between(born: Column, lo: int, hi: int, as_of: date | Column | None = None) -> Column:
    """``lo <= age_years(born) <= hi`` as a range of birth dates."""
    least = lo * DAYS_PER_YEAR if lo > 0 else (lo - 1) * DAYS_PER_YEAR + 1
    most = hi * DAYS_PER_YEAR + DAYS_PER_YEAR - 1 if hi >= 0 else hi * DAYS_PER_YEAR
    today = _as_of(as_of)
    return born.between(F.date_sub(today, most), F.date_sub(today, least))
