"""Expressions over bank statement texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DESCRIPTION_PATTERN, PL_ACCOUNTS
from .text import as_col, strip

PARSED_FIELDS = ("pl_account_number", "parsed_product_line_id", "parsed_product_id", "parsed_variant_id")


def _parsed(account: Column, line: Column, product: Column, variant: Column) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip((account, line, product, variant), PARSED_FIELDS)])


def _none() -> Column:
    return F.lit(None).cast("string")


def parse_bank_description(c: Column | str, first_token_fallback: bool = False) -> Column:
    """Description -> struct(pl_account_number, parsed_product_line_id, parsed_product_id, parsed_variant_id).

    Line and product are upper-cased, the variant stays as written. An account outside the known list becomes null while
    the ids stay. With ``first_token_fallback`` a first word that is three parts joined by underscores also counts.
    """
    text = as_col(c)
    # one search for the whole match, then a split of that short piece
    match = F.regexp_extract(text, DESCRIPTION_PATTERN, 0)
    parts = F.split(match, r"[_\s]+")
    found = match != ""
    account = F.get(parts, F.lit(3))
    line, product = (F.when(found, F.upper(F.get(parts, F.lit(i)))) for i in (0, 1))
    main = _parsed(F.when(account.isin(*PL_ACCOUNTS), account), line, product, F.get(parts, F.lit(2)))
    return F.when(found, main).otherwise(simple_token_ids(text)) if first_token_fallback else main


def simple_token_ids(c: Column | str) -> Column:
    """``X_Y_Z ...`` -> upper-cased ids from the first word if it has exactly three parts; account null."""
    parts = F.split(F.split(strip(as_col(c)), r"\s+").getItem(0), "_", -1)
    ok = F.size(parts) == 3
    ids = [F.when(ok, F.upper(F.get(parts, F.lit(i)))) for i in range(3)]
    return _parsed(_none(), *ids)
