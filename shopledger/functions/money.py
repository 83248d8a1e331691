"""Money expressions. Amounts are decimals: sums do not depend on the order in which partitions arrive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MONEY_SYMBOLS, NULL_WORDS, VND_PER_USD
from .text import MONEY, as_col, strip

AMOUNT = "decimal(20,4)"
# A number that can be read; whether it fits a type is another question.
_NUMBER = r"^[-+]?\d+(\.\d*)?$"


def out_of_range(text: Column, value: Column) -> Column:
    """True where ``text`` is a readable number and ``value``, what it was cast to, is null: the number does not fit."""
    return value.isNull() & F.coalesce(strip(text.cast("string")).rlike(_NUMBER), F.lit(False))


def fitting(c: Column, kind=MONEY) -> Column:
    """``c`` as ``kind``. Text that is no number gives null; a number that does not fit ends the job and is not lost."""
    text, value = c.cast("string"), c.try_cast(kind)
    error = F.raise_error(F.concat(F.lit("amount out of range: "), text)).cast(kind)
    return F.coalesce(value, F.when(out_of_range(text, value), error))


def _amount_text(c: Column) -> Column:
    """Drop separators, currency signs and the closing parenthesis; an opening one becomes a minus sign."""
    return F.translate(c, "(," + MONEY_SYMBOLS + ")", "-")


def _no_word(c: Column) -> Column:
    """False for text that begins with an ASCII letter: no number does, and a cast that fails raises inside, which takes many
    times as long as one that succeeds."""
    return (c < "A") | (c >= "{")


def plain_amount(c: Column, kind: str | T.DataType = AMOUNT, symbols: str = "," + MONEY_SYMBOLS) -> Column:
    """``c`` without ``symbols`` as ``kind``, null if that is no number that fits: the short way for most texts.

    Replacing one sign after the other leaves a text without it as it is; a translation makes every character anew.
    """
    value = reduce(lambda text, s: F.replace(text, F.lit(s), F.lit("")), symbols, c).try_cast(kind)
    return F.when(_no_word(c) & ~c.startswith("("), value)


def parse_currency(c: Column | str) -> Column:
    """Money text -> decimal(20,4). Blank and null give 0; text around a number is ignored; no number gives 0.

    A number that does not fit is an error, never 0.
    """
    text = strip(as_col(c).cast("string"))
    bare = _amount_text(text)
    first_number = F.regexp_extract(bare, r"-?\d+(\.\d+)?", 0)
    value = F.coalesce(F.when(_no_word(bare), bare.try_cast(AMOUNT)), F.when(first_number == "", F.lit(0).cast(AMOUNT)).otherwise(fitting(first_number, AMOUNT)))
    other = F.when(F.lower(text).isin("", "--", *NULL_WORDS) | text.isNull(), F.lit(0).cast(AMOUNT)).otherwise(value)
    return F.coalesce(plain_amount(as_col(c).cast("string")), other)


def clean_statement_currency(c: Column | str) -> Column:
    """Statement money text without separators and currency signs, minus sign kept; null stays null."""
    return strip(F.translate(as_col(c), "," + MONEY_SYMBOLS, ""))


def statement_amount(c: Column | str) -> Column:
    """Statement money text -> decimal(20,4); null and unreadable text give null, a number that does not fit is an error."""
    return F.coalesce(plain_amount(as_col(c)), fitting(clean_statement_currency(c), AMOUNT))


def to_usd(c: Column | str, scale: int = 1) -> Column:
    """VND amount (in 1/``scale`` units of the file) -> USD, rounded half up to cents."""
    return F.round(as_col(c).cast(AMOUNT) * F.lit(scale) / F.lit(VND_PER_USD), 2).cast(MONEY)


def is_vnd(currency: Column | str) -> Column:
    return F.upper(as_col(currency)).eqNullSafe("VND")


def vnd_to_usd(c: Column | str, currency: Column | str, scale: int = 1) -> Column:
    """USD amount of a row: converted where the row's currency is VND, rounded to cents everywhere."""
    return F.when(is_vnd(currency), to_usd(c, scale)).otherwise(F.round(as_col(c), 2).cast(MONEY))


def usd_currency(currency: Column | str) -> Column:
    return F.when(is_vnd(currency), F.lit("USD")).otherwise(as_col(currency))


def ratio(numerator: Column, denominator: Column, digits: int = 2) -> Column:
    """Exact decimal quotient rounded half up; null when the denominator is 0 or null.

    Both sides are narrowed first: a wide decimal divided by a wide one loses scale in Spark, and rounding what is
    left would round twice.
    """
    top = numerator.cast("decimal(20,2)")
    bottom = denominator.cast("decimal(17,2)")
    return F.round(F.try_divide(top, bottom), digits).cast(f"decimal(25,{digits})")


def in_currency(usd: Column, currency: str = "USD") -> Column:
    """Display currency of a report: USD as is, VND at the fixed rate without decimals."""
    if currency == "USD":
        return usd
    if currency == "VND":
        return F.round(usd * F.lit(VND_PER_USD), 0).cast("decimal(28,0)")
    raise ValueError(f"unknown currency {currency!r}")
