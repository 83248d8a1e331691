"""Date expressions."""

from __future__ import annotations

from calendar import month_name
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BANK_DATE
from .text import as_col, strip

# A two-digit year yy means 1969..2068; Spark's own pivot is 2000..2099.
_PIVOT_YEAR = 2069


def _plain_or(text: Column, fmt: str, other: Column) -> Column:
    """Date of three plain numbers between slashes in the order of ``fmt``, else ``other``.

    Put in ISO order such text is cast, which takes a fraction of the time of a parse by a pattern; the dates are the same.
    """
    names = fmt.split("/")
    digits = [r"\d{1,2}" if len(n) == 1 else rf"\d{{{len(n)}}}" for n in names]
    parts = [F.substring_index(text, "/", 1), F.substring_index(F.substring_index(text, "/", 2), "/", -1), F.substring_index(text, "/", -1)]
    part = {n[0]: p for n, p in zip(names, parts)}
    century = [] if "yyyy" in names else [F.when(part["y"] >= str(_PIVOT_YEAR % 100), "19").otherwise("20")]
    iso = F.concat(*century, part["y"], F.lit("-"), part["M"], F.lit("-"), part["d"])
    return F.when(text.rlike(r"\A" + "/".join(digits) + r"\z"), iso.try_cast("date")).otherwise(other)


def _named_month_or(text: Column, other: Column) -> Column:
    """Date of ``March 5, 2020`` with the month as written here, else ``other``; in ISO order it is cast, as above."""
    name, rest = F.substring_index(text, " ", 1), F.substring_index(text, " ", -2)
    month = reduce(lambda found, m: F.when(name == m[1], f"-{m[0]:02d}-").otherwise(found), reversed([*enumerate(month_name)][1:]), F.lit(None).cast("string"))
    iso = F.concat(F.substring_index(rest, " ", -1), month, F.substring_index(rest, ",", 1))
    return F.when(text.rlike(r"\A(?:" + "|".join(month_name[1:]) + r") \d{1,2}, [1-9]\d{3}\z"), iso.try_cast("date")).otherwise(other)


def parse_date(c: Column | str, fmt: str) -> Column:
    """Text -> date; bad text gives null. Two-digit years from 69 on belong to the 20th century."""
    parsed = F.try_to_date(strip(as_col(c)), fmt)
    if "yyyy" not in fmt:
        parsed = F.when(F.year(parsed) >= _PIVOT_YEAR, F.add_months(parsed, -1200)).otherwise(parsed)
    if fmt == "MMMM d, yyyy":
        return _named_month_or(as_col(c), parsed)
    return _plain_or(as_col(c), fmt, parsed) if "/" in fmt else parsed


def day_first_date(c: Column | str) -> Column:
    """Bank date: ISO, or day first with ``/`` or ``-``, with or without a time of day."""
    text = F.substring_index(F.substring_index(strip(as_col(c)), " ", 1), "T", 1)
    # the shape decides the format: a failed parse raises inside and is far slower than a successful one
    other = (
        F.when(text.contains("/"), F.try_to_date(text, BANK_DATE))
        .when(text.rlike(r"^\d{4}-"), F.try_to_date(text, "yyyy-M-d"))
        .when(text.contains("-"), F.try_to_date(text, "d-M-yyyy"))
    )
    return _plain_or(as_col(c), BANK_DATE, other)


def date_key(c: Column | str) -> Column:
    """``YYYYMMDD`` integer of a date."""
    d = as_col(c)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def key_date(c: Column | str) -> Column:
    """Date of a ``YYYYMMDD`` integer; null if it is no date."""
    return F.try_to_date(as_col(c).cast("string"), "yyyyMMdd")


def month_label(year: Column | str, month: Column | str) -> Column:
    return F.concat(as_col(year).cast("string"), F.lit("-"), F.lpad(as_col(month).cast("string"), 2, "0"))
