"""Expressions over marketplace statement lines."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FEE_LINES, FEE_WORDS, REVENUE_WORDS
from .text import as_col

# The number that follows a reference word, with an optional ":" or "#" between them.
_NUMBER = r"\s*[:#]?\s*(\d+)"
ORDER_NUMBER = "(?i)order(?: id)?" + _NUMBER
LISTING_NUMBER = "(?i)listing(?: id)?" + _NUMBER
TRANSACTION_NUMBER = "(?i)transaction(?: id)?" + _NUMBER
BARE_NUMBER = "#" + _NUMBER
ORDER_OR_BARE_NUMBER = "(?i)(?:order(?: id)?|#)" + _NUMBER


def extract_id_from_info(c: Column | str, bare_hash_first: bool = False) -> Column:
    """Info text -> struct(extracted_id, id_type, info_description); null where no id is found.

    ``Listing #5`` is a listing. With ``bare_hash_first`` any ``#number`` counts as an order, whatever word precedes it.
    """
    text = as_col(c)
    low = F.lower(text)

    def found(pattern: str, kind: str) -> Column:
        number = F.regexp_extract(text, pattern, 1)
        # a text without the pattern's word, here the first part of the kind or a "#", is not searched
        word = low.contains("#") if pattern in (BARE_NUMBER, ORDER_OR_BARE_NUMBER) else low.contains(kind.removesuffix("_id"))
        word = word | low.contains("order") if pattern == ORDER_OR_BARE_NUMBER else word
        return F.when(
            word & (number != ""),
            F.struct(number.alias("extracted_id"), F.lit(kind).alias("id_type"), text.alias("info_description")),
        )

    if bare_hash_first:
        rules = [(ORDER_OR_BARE_NUMBER, "order_id"), (LISTING_NUMBER, "listing_id"), (TRANSACTION_NUMBER, "transaction_id")]
    else:
        rules = [
            (ORDER_NUMBER, "order_id"),
            (LISTING_NUMBER, "listing_id"),
            (TRANSACTION_NUMBER, "transaction_id"),
            (BARE_NUMBER, "order_id"),
        ]
    return F.coalesce(*[found(p, k) for p, k in rules])


def _cascade(rules: list[tuple[Column, str]], default: Column) -> Column:
    return reduce(lambda rest, rule: F.when(rule[0], F.lit(rule[1])).otherwise(rest), reversed(rules), default)


def categorize_revenue_type(c: Column | str) -> Column:
    """Statement type -> Sale, Deposit, Refund, Fee, Tax or Other; null -> Unknown."""
    low = F.lower(as_col(c))
    rules = [(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), label) for label, words in REVENUE_WORDS]
    return F.when(low.isNull(), F.lit("Unknown")).otherwise(_cascade(rules, F.lit("Other")))


def categorize_fee_type(c: Column | str) -> Column:
    """Statement type -> fee family, or null."""
    low = F.lower(as_col(c))
    return _cascade([(low.contains(word), label) for label, word in FEE_WORDS], F.lit(None).cast("string"))


def fee_line(kind: str, fragment: str | None, type_col="transaction_type", title_col="transaction_title") -> Column:
    """True for statement lines of one fee line; never null."""
    match = as_col(type_col) == kind
    if fragment is not None:
        # a LIKE pattern: the underscore in a fragment stands for any one character
        match = match & as_col(title_col).ilike(f"%{fragment}%")
    return F.coalesce(match, F.lit(False))


def fee_name(type_col="transaction_type", title_col="transaction_title") -> Column:
    """Name of the first fee line that a statement line belongs to; null for lines that are no platform fee."""
    rules = [(fee_line(kind, part, type_col, title_col), name) for _, kind, part, name in FEE_LINES]
    return _cascade(rules, F.lit(None).cast("string"))


def is_platform_fee() -> Column:
    """``fee_name`` is not null: per statement type one look at the title, and none where the type alone decides."""
    found = []
    for kind in dict.fromkeys(kind for _, kind, *_ in FEE_LINES):
        parts = [part for _, k, part, _ in FEE_LINES if k == kind]
        match = F.col("transaction_type") == kind
        if None not in parts:
            # as in ``fee_line`` an underscore stands for any one character
            words = "|".join(re.escape(part.lower()).replace("_", ".") for part in parts)
            match = match & F.lower("transaction_title").rlike(f"(?s){words}")
        found.append(match)
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def fee_rank(name: Column | str) -> Column:
    """Fixed report position of a fee name."""
    names = [n for *_, n in FEE_LINES]
    return F.array_position(F.array(*[F.lit(n) for n in names]), as_col(name)).cast("int")
