"""Text expressions: null tokens, whitespace, lists, header names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NULL_STRINGS, NULL_TOKENS, NULL_WORDS, STAR_MONEY

MONEY = T.DecimalType(15, 2)


def as_col(c: Column | str) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


# Whitespace as Unicode defines it. Listed, because trimming by a character list and replacing by a plain character class
# are several times faster than a Unicode-aware pattern.
WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# a run of whitespace, or one whitespace character other than the blank
_UNTIDY = _WS + "{2,}|" + _WS.replace(r"\x1c-\x20", r"\x1c-\x1f")
# What text must hold for ``squash`` to change it, as a pattern that costs a third of the exact one: a blank at an end, two
# blanks, or a character beyond printable ASCII.
_MAYBE_UNTIDY = r"^ | \z|  |[^ -~]"


def strip(c: Column | str) -> Column:
    """Remove all leading and trailing whitespace, not only blanks."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def squash(c: Column | str) -> Column:
    """Strip, and turn each inner run of whitespace into one blank."""
    text = as_col(c)
    return F.when(text.rlike(_MAYBE_UNTIDY), F.regexp_replace(strip(text), _UNTIDY, " ")).otherwise(text)


def null_if_in(c: Column, words: Iterable[str]) -> Column:
    return F.when(~c.isin(*words), c)


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _map_columns(df: DataFrame, names: Iterable[str], fn) -> DataFrame:
    chosen = set(names)
    return df.select(*[fn(as_col(n)).alias(n) if n in chosen else as_col(n) for n in df.columns])


def null_tokens(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace the raw files' "no value" tokens by null in text columns."""
    return _map_columns(df, columns or _string_columns(df), lambda c: null_if_in(c, NULL_TOKENS))


def null_strings(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Replace text spellings of null (None, nan, blank, ...) by null in text columns."""
    return _map_columns(df, columns or _string_columns(df), lambda c: null_if_in(c, NULL_STRINGS))


LONG_IDS = ("listing_id", "order_id", "transaction_id")
MONEY_COLUMNS = frozenset(c for columns in STAR_MONEY.values() for c in columns)


def coerce_star_types(df: DataFrame) -> DataFrame:
    """``null_strings``, then text surrogate keys and ids to bigint and text in the money columns of the star to money; bad text gives null."""
    text = set(_string_columns(df))
    out = []
    for name in df.columns:
        c = as_col(name)
        if name in text:
            c = null_if_in(c, NULL_STRINGS)
            if name.endswith("_key") or name in LONG_IDS:
                c = whole_number(c)
            elif name in MONEY_COLUMNS:
                c = c.try_cast(MONEY)
        out.append(c.alias(name))
    return df.select(*out)


def whole_number(c: Column | str) -> Column:
    """Text id to bigint; accepts a trailing ``.0``; bad text gives null."""
    text = strip(as_col(c).cast("string"))
    other = F.when(text.contains("."), F.regexp_replace(text, r"\.0+$", "")).otherwise(text).try_cast("bigint")
    return F.coalesce(as_col(c).cast("string").try_cast("bigint"), other)


def clean_text(c: Column | str, max_len: int | None = None) -> Column:
    """Null for blank and null words; inner whitespace collapsed; cut to ``max_len`` characters."""
    text = as_col(c).cast("string")

    def cut(t: Column) -> Column:
        return t if max_len is None else F.substring(t, 1, max_len)

    def named(t: Column) -> Column:
        return ~F.lower(t).isin("", *NULL_WORDS)

    # the one element is the tidy text: as a variable it is made once, not for the test and again for the value
    other = F.transform(F.array(cut(squash(text))), lambda t: F.when(named(t), t))[0]
    # a lambda is interpreted: text that is tidy as it stands goes without
    return F.when(text.isNull(), text).when(~text.rlike(_MAYBE_UNTIDY) & named(cut(text)), cut(text)).otherwise(other)


def snake_name(name: str) -> str:
    """``Fees & Taxes`` -> ``fees_taxes``; letters with accents are kept."""
    return re.sub(r"_+", "_", "_".join(re.findall(r"\w+", name.lower())))


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_name(n) for n in df.columns])


def split_commas(c: Column | str) -> Column:
    """Plain comma split; null gives one empty element."""
    return F.split(F.coalesce(as_col(c), F.lit("")), ",", -1)


def _tidy_items(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))


def parse_list(c: Column | str) -> Column:
    """JSON array or comma list -> trimmed, non-empty items; null words give an empty array."""
    text = strip(as_col(c))
    as_json = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))
    items = _tidy_items(F.coalesce(as_json, F.split(text, ",", -1)))
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | F.lower(text).isin("", *NULL_WORDS), empty).otherwise(items)


def sku_to_list(c: Column | str) -> Column:
    """One SKU text or a JSON array -> array; commas inside a plain text are kept."""
    text = as_col(c)
    as_json = F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))
    empty = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == ""), empty).otherwise(F.coalesce(as_json, F.array(text)))
