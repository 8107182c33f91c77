"""Reporting periods: fiscal quarter, calendar month, all data.

A period is a half-open date range, so it prunes partitions and reaches the Parquet
footers, and a timestamp on the last day still counts. Bounds are dates, or columns
holding a scalar subquery when the period hangs on the newest date in the data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as D


@dataclass(frozen=True)
class Period:
    start: date | Column | None
    end: date | Column | None  # exclusive
    label: str
    months: bool = False  # bounds that are columns are known to be first days of months

    @property
    def whole_months(self) -> bool:
        if self.start is None or self.months:
            return True
        return all(isinstance(b, date) and b.day == 1 for b in (self.start, self.end))

    def covers(self, day: Column) -> Column:
        if self.start is None:
            return F.lit(True)
        return (day >= _bound(self.start)) & (day < _bound(self.end))

    def of(self, df: DataFrame, day: str) -> DataFrame:
        """Rows of the period; a table partitioned by the month of ``day`` is pruned to its months."""
        if self.start is None:
            return df
        month = f"{day}_month"
        if month in df.columns:
            last = F.date_sub(_bound(self.end), 1)
            df = df.where(F.col(month).between(D.month_key(_bound(self.start)), D.month_key(last)))
        return df.where(self.covers(F.col(day)))


def _bound(b: date | Column) -> Column:
    return b if isinstance(b, Column) else F.lit(b)


ALL_DATA = Period(None, None, "all available data")


def fiscal_year(d: date) -> int:
    return d.year + (d.month >= 4)


def fiscal_quarter(d: date) -> int:
    return (d.month - 4) % 12 // 3 + 1


def fiscal_quarter_bounds(fy: int, fq: int) -> tuple[date, date]:
    """First and last day."""
    start = date(fy if fq == 4 else fy - 1, (fq * 3) % 12 + 1, 1)
    after = date(start.year + (start.month == 10), (start.month + 2) % 12 + 1, 1)
    return start, after - timedelta(days=1)


def last_complete_fiscal_quarter(ref: date) -> tuple[int, int, date, date]:
    """The newest quarter that ended on or before ``ref``."""
    # The day after `ref` lies in the first quarter that has not ended yet.
    tomorrow = ref + timedelta(days=1)
    open_start, _ = fiscal_quarter_bounds(fiscal_year(tomorrow), fiscal_quarter(tomorrow))
    end = open_start - timedelta(days=1)
    fy, fq = fiscal_year(end), fiscal_quarter(end)
    return fy, fq, fiscal_quarter_bounds(fy, fq)[0], end


def last_complete_calendar_month(ref: date) -> tuple[date, date]:
    end = (ref + timedelta(days=1)).replace(day=1) - timedelta(days=1)
    return end.replace(day=1), end


_MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")


def period(fiscal_year: int | None = None, fiscal_quarter: int | None = None, month: str | None = None) -> Period:
    """Month wins over fiscal quarter; year and quarter only go together."""
    if fiscal_year is not None and not 2000 <= fiscal_year <= 2100:
        raise ValueError("fiscal_year must be within 2000..2100")
    if fiscal_quarter is not None and not 1 <= fiscal_quarter <= 4:
        raise ValueError("fiscal_quarter must be within 1..4")
    if month:
        if not _MONTH.fullmatch(month):
            raise ValueError("month must be formatted YYYY-MM")
        start = date(int(month[:4]), int(month[5:]), 1)
        after = (start + timedelta(days=31)).replace(day=1)
        return Period(start, after, f"month {month}")
    if (fiscal_year is None) != (fiscal_quarter is None):
        raise ValueError("fiscal_year and fiscal_quarter must be given together")
    if fiscal_year is None:
        return ALL_DATA
    start, last = fiscal_quarter_bounds(fiscal_year, fiscal_quarter)
    return Period(start, last + timedelta(days=1), f"FY{fiscal_year} Q{fiscal_quarter}")


def newest_day(df: DataFrame, day: str = "order_date") -> DataFrame:
    """The data's own "today", as a one-row frame."""
    return df.agg(F.max(day).alias("as_of"))


def last_quarter_of(as_of: DataFrame) -> Period:
    """Last complete fiscal quarter before the day in the one-row frame ``as_of``.

    Fiscal quarters start where calendar quarters do, so truncation finds them.
    """
    end = F.trunc(F.date_add(as_of.scalar(), 1), "quarter")
    return Period(F.add_months(end, -3), end, "last complete fiscal quarter", True)


def last_month_of(as_of: DataFrame) -> Period:
    end = F.trunc(F.date_add(as_of.scalar(), 1), "month")
    return Period(F.add_months(end, -1), end, "last complete month", True)


def reporting_periods(as_of: DataFrame) -> DataFrame:
    """One row: newest day, last complete month, last complete fiscal quarter."""
    tomorrow = F.date_add("as_of", 1)
    quarter_start = F.add_months(F.trunc(tomorrow, "quarter"), -3)
    month_start = F.add_months(F.trunc(tomorrow, "month"), -1)
    return as_of.select(
        "as_of",
        D.month_key(month_start).alias("last_month"),
        D.fiscal_year(quarter_start).alias("last_fiscal_year"),
        D.fiscal_quarter(quarter_start).alias("last_fiscal_quarter"),
        quarter_start.alias("quarter_start"),
        F.date_sub(F.trunc(tomorrow, "quarter"), 1).alias("quarter_end"),
    )


def fiscal_quarters(dim_date: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """All fiscal quarters that overlap the data window, newest first."""
    d = F.col("date")
    return (
        dim_date.where((d >= first_day) & (d <= last_day))
        .select(
            "fiscal_year",
            "fiscal_quarter",
            F.trunc(d, "quarter").alias("quarter_start"),
            F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1).alias("quarter_end"),
        )
        .distinct()
        .orderBy(F.desc("fiscal_year"), F.desc("fiscal_quarter"))
    )
