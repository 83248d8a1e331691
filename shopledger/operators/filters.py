"""Report filters: dates, customer type, argument resolution."""

from __future__ import annotations

import calendar
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_key

_ISO = re.compile(r"\d{4}-\d{2}-\d{2}")


def valid_date(value: str | None) -> str | None:
    """The value if it looks like ``YYYY-MM-DD``, else None: a malformed bound does not filter."""
    return value if value and _ISO.fullmatch(value) else None


def month_bounds(year: int, month: int) -> tuple[str, str]:
    last = calendar.monthrange(year, month)[1]
    return f"{year:04d}-{month:02d}-01", f"{year:04d}-{month:02d}-{last:02d}"


def resolve_dates(
    start: str | None = None, end: str | None = None, year: int | None = None, month: int | None = None
) -> tuple[str | None, str | None]:
    """Report bounds: reversed dates are swapped, one first-of-month given twice means that month, a year or month expands."""
    if start or end:
        if start and end and start > end:
            start, end = end, start
        if start and start == end and re.fullmatch(r"\d{4}-\d{2}-01", start):
            return month_bounds(int(start[:4]), int(start[5:7]))
        return start or None, end or None
    if year is None:
        return None, None
    if month is None:
        return f"{year:04d}-01-01", f"{year:04d}-12-31"
    return month_bounds(year, month)


def date_filter(
    fact: DataFrame,
    dim_time: DataFrame,
    key: str,
    start: str | None = None,
    end: str | None = None,
    attributes: Sequence[str] = (),
    how: str = "inner",
) -> DataFrame:
    """Fact rows of calendar days in an inclusive range, with calendar attributes.

    The range is put on the fact's date key as well, so that it prunes partitions and row groups of the scan. The
    calendar side has one row per day; the planner broadcasts it by its size. With ``how='left'`` the rows outside the
    range stay, with null attributes.
    """
    days, rows = dim_time, fact
    for bound, above in ((valid_date(start), True), (valid_date(end), False)):
        if bound is None:
            continue
        day = F.lit(bound).cast("date")
        days = days.filter(F.col("full_date") >= day if above else F.col("full_date") <= day)
        if how == "inner":
            limit = date_key(day)
            rows = rows.filter(F.col(key) >= limit if above else F.col(key) <= limit)
    return rows.join(days.select(F.col("time_key").alias(key), *attributes), key, how)


def customer_classes(sales: DataFrame) -> DataFrame:
    """(customer_key, customer_class): 'new' with one distinct order in the whole fact, 'return' with more.

    One order means that the smallest and the largest order key are equal: one shuffle on the customer with map-side
    reduction, where a distinct count would shuffle every (customer, order) pair first.
    """
    span = (
        sales.filter(F.col("customer_key").isNotNull())
        .groupBy("customer_key")
        .agg(F.min("order_key").alias("lo"), F.max("order_key").alias("hi"))
    )
    return span.select("customer_key", order_class("lo", "hi").alias("customer_class"))


def order_class(lo: str, hi: str) -> Column:
    return F.when(F.col(lo) == F.col(hi), "new").when(F.col(lo) < F.col(hi), "return")


def customer_filter(rows: DataFrame, sales: DataFrame, customer_type: str = "all") -> DataFrame:
    """Rows of new or returning customers, judged over the whole fact ``sales``; 'all' also keeps null customers."""
    if customer_type not in ("new", "return"):
        return rows
    chosen = customer_classes(sales).filter(F.col("customer_class") == customer_type)
    return rows.join(chosen.select("customer_key"), "customer_key", "left_semi")
