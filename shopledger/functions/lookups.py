"""Fixed lookups as literal maps inside the expression: no join, no broadcast."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import as_col


def _lookup(table: dict, key: Column, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(pairs, key)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def retail_season(month: Column | str) -> Column:
    return _lookup(K.RETAIL_SEASONS, as_col(month), "Unknown")


def selling_season(month: Column | str) -> Column:
    out = F.lit("Regular")
    for label, months in K.SELLING_SEASONS:
        out = F.when(as_col(month).isin(*months), F.lit(label)).otherwise(out)
    return out


def is_peak_season(month: Column | str) -> Column:
    return as_col(month).isin(*K.PEAK_MONTHS)


def country_columns(country: Column | str) -> dict[str, Column]:
    """Business attributes of a country name."""
    c = as_col(country)
    return {
        "continent": _lookup(K.CONTINENTS[0], c, K.CONTINENTS[1]),
        "region": _lookup(K.REGIONS[0], c, K.REGIONS[1]),
        "market": _lookup(K.MARKETS[0], c, K.MARKETS[1]),
        "shipping_zone": F.when(c == K.HOME_COUNTRY, "Domestic").otherwise("International"),
        "currency_code": _lookup(K.CURRENCIES[0], c, K.CURRENCIES[1]),
        "timezone": _lookup(K.TIME_ZONES[0], c, K.TIME_ZONES[1]),
    }


def account_label(account: Column | str) -> Column:
    """Breakdown label of a profit-and-loss account."""
    return _lookup({a: label for a, (_, label) in K.PL_ACCOUNTS.items()}, as_col(account), None)
