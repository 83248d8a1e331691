"""Deletes as the rows that stay. ``sinks.rewrite_months`` or ``sinks.rewrite_table`` store the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_key
from ..functions.text import as_col


def _keep(df: DataFrame, doomed: Column) -> DataFrame:
    return df.filter(~F.coalesce(doomed, F.lit(False)))


def _known_dates(fact: DataFrame, dim_time: DataFrame, low: Column, high: Column) -> DataFrame:
    """Fact rows with ``__known``: true if their date is a calendar row inside the range."""
    days = dim_time.filter(F.col("full_date").between(low, high))
    days = days.select(F.col("time_key").alias("transaction_date_key"), F.lit(True).alias("__known"))
    return fact.join(days, "transaction_date_key", "left")


def delete_bank_period(fact: DataFrame, dim_time: DataFrame, period: str) -> DataFrame:
    """Bank rows outside the calendar month ``YYYY-MM``."""
    first = F.lit(f"{period}-01").cast("date")
    marked = _known_dates(fact, dim_time, first, F.last_day(first))
    return _keep(marked, F.col("__known")).select(*fact.columns)


def delete_bank_by_accounts(
    fact: DataFrame, dim_time: DataFrame, start: str, end: str, pl_accounts: Sequence[str], account_number: str | None = None
) -> DataFrame:
    """Bank rows left after deleting profit-and-loss accounts inside a date range, of one bank account if given."""
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    doomed = F.col("pl_account_number").isin(*pl_accounts) & F.col("__known")
    if account_number is not None:
        doomed = doomed & (F.col("account_number") == account_number)
    return _keep(_known_dates(fact, dim_time, low, high), doomed).select(*fact.columns)


def delete_by_ids(df: DataFrame, key: str, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Rows whose key is not listed; a short list is a literal filter, a table of ids an anti join."""
    if isinstance(ids, DataFrame):
        gone = ids.select(as_col(ids.columns[0]).alias(key))
        return df.join(gone, key, "left_anti").select(*df.columns)
    return _keep(df, as_col(key).isin(*[int(i) for i in ids])) if ids else df


def date_range_keys(start: str, end: str) -> Column:
    """Predicate on stored date keys that covers a date range; it reaches the Parquet scan."""
    return F.col("transaction_date_key").between(date_key(F.lit(start).cast("date")), date_key(F.lit(end).cast("date")))
