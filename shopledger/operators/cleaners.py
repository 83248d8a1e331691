"""Cleaners of the eight raw datasets: one projection each, no shuffle except the catalog's dedup."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    BANK_HEADERS,
    CATALOG_HEADERS,
    CATALOG_KEY,
    CATALOG_NAMES,
    CHECKOUT_MONEY,
    DEPOSIT_DATE,
    ITEM_NUMBERS,
    ITEM_TEXT,
    LONG_DATE,
    ORDER_ADDRESS,
    ORDER_DATES,
    ORDER_NUMBERS,
    ORDER_STATUSES,
    ORDER_TEXT,
    ORDER_VND,
    SHORT_DATE,
    STATEMENT_DATE,
    STATEMENT_MONEY,
)
from ..functions.bank import PARSED_FIELDS, parse_bank_description
from ..functions.dates import day_first_date, parse_date
from ..functions.listing import VARIATION_FIELDS, clean_description, extract_variations, parse_listing_description
from ..functions.money import is_vnd, out_of_range, parse_currency, plain_amount, statement_amount, to_usd, usd_currency, vnd_to_usd
from ..functions.statement import categorize_fee_type, categorize_revenue_type, extract_id_from_info
from ..functions.text import (
    MONEY,
    WHITESPACE,
    as_col,
    clean_text,
    null_tokens,
    snake_case_columns,
    snake_name,
    split_commas,
    squash,
)
from ..session import through_table
from .keys import keep_first, row_order


def _apply(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Replace or add columns in one projection."""
    kept = [changes.get(c, as_col(c)).alias(c) for c in df.columns]
    added = [v.alias(k) for k, v in changes.items() if k not in df.columns]
    return df.select(*kept, *added)


def _present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def clean_statement(raw: DataFrame) -> DataFrame:
    """Marketplace statement: dates, money in USD, ids from Info, revenue and fee family."""
    df = null_tokens(raw)
    has_currency = "Currency" in df.columns
    changes = {}
    if "Date" in df.columns:
        changes["Date"] = parse_date("Date", STATEMENT_DATE)
    for c in _present(df, STATEMENT_MONEY):
        amount = statement_amount(c)
        changes[c] = vnd_to_usd(amount, "Currency") if has_currency else F.round(amount, 2).cast("decimal(15,2)")
    if has_currency:
        changes["Currency"] = usd_currency("Currency")
    if "Info" in df.columns:
        changes["__id"] = extract_id_from_info("Info")
    if "Type" in df.columns:
        changes["revenue_type"] = categorize_revenue_type("Type")
        changes["fee_type"] = categorize_fee_type("Type")
    out = snake_case_columns(_apply(df, changes))
    if "Info" in df.columns:
        out = out.select(*[c for c in out.columns if c != "_id"], F.col("_id.*"))
    return out


def _status(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda rest, s: F.when(low == s.lower(), F.lit(s)).otherwise(rest), ORDER_STATUSES, c)


def clean_sold_orders(raw: DataFrame) -> DataFrame:
    """Orders. Card fees and net come in 1/100 VND and are always converted; SKU becomes a list."""
    df = null_tokens(raw)
    changes = {c: parse_date(c, SHORT_DATE) for c in _present(df, ORDER_DATES)}
    for c in _present(df, ORDER_NUMBERS):
        changes[c] = to_usd(parse_currency(c), 100) if c in ORDER_VND else parse_currency(c)
    for c in _present(df, ORDER_TEXT + ORDER_ADDRESS):
        changes[c] = _status(squash(c)) if c == "Order Status" else squash(c)
    if "SKU" in df.columns:
        changes["SKU"] = split_commas("SKU")
    return snake_case_columns(_apply(df, changes))


def clean_sold_order_items(raw: DataFrame) -> DataFrame:
    """Order items: sale date with two-digit year, other dates with four; variations as columns."""
    df = null_tokens(raw)
    changes = {}
    if "Sale Date" in df.columns:
        changes["Sale Date"] = parse_date("Sale Date", SHORT_DATE)
    changes |= {c: parse_date(c, LONG_DATE) for c in _present(df, ("Date Paid", "Date Shipped"))}
    changes |= {c: parse_currency(c) for c in _present(df, ITEM_NUMBERS)}
    changes |= {c: squash(c) for c in _present(df, ITEM_TEXT)}
    if "Variations" in df.columns:
        changes["__found"] = extract_variations("Variations")
    out = _apply(df, changes)
    if "Variations" in df.columns:
        # a second projection, so that the fields are read from one result
        added = {f: F.col("__found")[f] for f in VARIATION_FIELDS}
        # no source states a personalization; the column stays for the fact's schema
        added["personalization"] = F.lit(None).cast("string")
        out = _apply(out, added).drop("__found")
    return snake_case_columns(out)


def clean_direct_checkout(raw: DataFrame) -> DataFrame:
    """Payments: six amounts; those of VND rows come in 1/100 VND."""
    df = null_tokens(raw)
    changes = {}
    if "Order Date" in df.columns:
        changes["Order Date"] = parse_date("Order Date", LONG_DATE)
    for c in _present(df, CHECKOUT_MONEY):
        amount = parse_currency(c)
        if "Currency" in df.columns:
            amount = F.when(is_vnd("Currency"), to_usd(amount, 100)).otherwise(amount)
        changes[c] = amount
    if "Currency" in df.columns:
        changes["Currency"] = usd_currency("Currency")
    return snake_case_columns(_apply(df, changes))


def clean_deposits(raw: DataFrame) -> DataFrame:
    """Payouts: date, amount in USD."""
    df = null_tokens(raw)
    changes = {}
    if "Date" in df.columns:
        changes["Date"] = parse_date("Date", DEPOSIT_DATE)
    if "Amount" in df.columns:
        amount = parse_currency("Amount")
        if "Currency" in df.columns:
            amount = F.when(is_vnd("Currency"), to_usd(amount)).otherwise(amount)
            changes["Currency"] = usd_currency("Currency")
        changes["Amount"] = amount
    return snake_case_columns(_apply(df, changes))


def clean_listing(raw: DataFrame) -> DataFrame:
    """Listings: comma lists, cleaned description and its sections (country as ``country_origin``)."""
    changes = {}
    if "TAGS" in raw.columns:
        changes["tags_list"] = split_commas("TAGS")
    if "MATERIALS" in raw.columns:
        changes["materials_list"] = split_commas("MATERIALS")
    if "SKU" in raw.columns:
        changes["SKU"] = split_commas("SKU")
    df = _apply(raw, changes)
    if "DESCRIPTION" in raw.columns:
        # two projections, so that the cleaned text is an attribute and not repeated inside each section's pattern
        df = df.withColumn("description_clean", clean_description("DESCRIPTION"))
        df = df.withColumn("section", parse_listing_description("description_clean"))
        names = [f.name for f in df.schema["section"].dataType.fields]
        parts = [F.col("section")[n].alias("country_origin" if n == "country" else n) for n in names]
        df = df.select(*[as_col(c) for c in df.columns if c != "section"], *parts)
    return snake_case_columns(df)


def bank_header(name: str) -> str | None:
    """Column of a bank export header, Vietnamese or English; None if it is not known."""
    low = name.lower()
    for column, words, also in BANK_HEADERS:
        if any(w in low for w in words) and (not also or any(w in low for w in also)):
            if column == "balance_after_transaction" and "after" in low and "số dư" not in low and "so du" not in low:
                continue
            return column
    return None


def _rename_bank(raw: DataFrame) -> DataFrame:
    taken, names = set(), []
    for c in raw.columns:
        target = bank_header(c)
        if target is None or target in taken:
            target = snake_name(c)
        taken.add(target)
        names.append(target)
    return raw.toDF(*names)


def _bank_amount(c: Column) -> Column:
    text = F.translate(c, "," + WHITESPACE, "")
    value = F.coalesce(plain_amount(c, MONEY, ","), text.try_cast(MONEY))
    return F.struct(value.alias("value"), out_of_range(text, value).alias("too_large"))


def normalize_bank(raw: DataFrame, first_token_fallback: bool = False) -> DataFrame:
    """Bank rows under their standard names, typed, with parsed ids, and ``__rejection``: why a row cannot be stored, or ""."""
    df = null_tokens(_rename_bank(raw))
    text = ("reference_number", "account_number", "account_name", "transaction_description")
    dates = ("transaction_date", "opening_date")
    money = ("credit_amount", "debit_amount", "balance_after_transaction")
    missing = [c for c in (*text, *dates, *money) if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("string") for c in missing}) if missing else df
    changes: dict[str, Column] = {
        "account_number": clean_text("account_number"),
        "account_name": clean_text("account_name"),
    }
    changes |= {c: day_first_date(c) for c in dates}
    changes["__amounts"] = F.struct(*[_bank_amount(as_col(c)).alias(c) for c in money])
    changes["__parsed"] = parse_bank_description("transaction_description", first_token_fallback)
    read = _apply(df, changes)
    amount = {c: F.col("__amounts")[c] for c in money}
    too_large = [F.when(amount[c]["too_large"], F.lit(f"{c} out of range")) for c in money]
    missing_account = F.when(F.col("account_number").isNull(), F.lit("missing account_number"))
    typed = {c: amount[c]["value"] for c in money} | {"account_name": F.coalesce("account_name", "account_number")}
    # a row's number is never below 0: as it may differ from run to run, no filter on the reason is moved below this projection,
    # where all that the reason comes from would be computed a second time
    reason = F.when(F.monotonically_increasing_id() >= 0, F.concat_ws("; ", missing_account, *too_large))
    out = _apply(read, typed | {"__rejection": reason})
    out = out.select(*[c for c in out.columns if c not in ("__parsed", "__amounts")], *[F.col("__parsed")[f].alias(f) for f in PARSED_FIELDS])
    return out.withColumn("is_business_related", F.col("parsed_product_line_id").isNotNull())


def _accepted(bank: DataFrame) -> DataFrame:
    return bank.filter(F.col("__rejection") == "").drop("__rejection")


def _rejected(bank: DataFrame) -> DataFrame:
    return bank.filter(F.col("__rejection") != "").withColumnRenamed("__rejection", "message")


def clean_bank_transactions(raw: DataFrame, first_token_fallback: bool = False) -> DataFrame:
    """Bank rows that name an account and whose amounts fit."""
    return _accepted(normalize_bank(raw, first_token_fallback))


def rejected_bank_rows(raw: DataFrame) -> DataFrame:
    """Bank rows without an account number or with an amount that does not fit, with a message; such an amount is null."""
    return _rejected(normalize_bank(raw))


def split_bank_rows(raw: DataFrame, first_token_fallback: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected bank rows. The rows are read and typed once, written, and both parts filter what was written."""
    rows = through_table(normalize_bank(raw, first_token_fallback), "bank-rows")
    return _accepted(rows), _rejected(rows)


def bank_parse_stats(bank: DataFrame) -> DataFrame:
    """Rows, rows whose description named a product, and their share in percent."""
    parsed = F.col("parsed_product_line_id").isNotNull()
    n, hit = F.count("*"), F.count_if(parsed)
    share = F.round(F.try_divide(hit.cast("decimal(19,0)") * 100, n.cast("decimal(19,0)")), 1)
    return bank.agg(n.alias("row_count"), hit.alias("parsed_rows"), share.cast("decimal(5,1)").alias("parsed_percent"))


def rename_catalog(raw: DataFrame) -> DataFrame:
    """The six catalog columns, under either header spelling; absent ones are null."""
    by_target: dict[str, str] = {}
    # the longer header is the newer one and wins where both are present
    for header, target in sorted(CATALOG_HEADERS.items(), key=lambda kv: -len(kv[0])):
        for c in raw.columns:
            if c.strip().lower() in (header, target) and target not in by_target:
                by_target[target] = c
    wanted = ("product_line_id", "product_line_name", "product_id", "product_name", "variant_id", "variant_name")
    extra = [as_col(c) for c in raw.columns if c.startswith("_")]
    return raw.select(
        *[(as_col(by_target[t]) if t in by_target else F.lit(None)).cast("string").alias(t) for t in wanted], *extra
    )


def clean_product_catalog(raw: DataFrame, order_by: Iterable[str] = ()) -> DataFrame:
    """Catalog rows with a full natural key, one per key: the first in the file, or by ``order_by`` (columns named ``_...``)."""
    df = rename_catalog(raw)
    changes = {c: clean_text(c, 50) for c in CATALOG_KEY} | {c: clean_text(c, 200) for c in CATALOG_NAMES}
    tidy = _apply(df, changes).dropna(subset=list(CATALOG_KEY))
    first = keep_first(tidy, CATALOG_KEY, list(order_by) or row_order(tidy, CATALOG_KEY))
    return first.select("product_line_id", "product_line_name", "product_id", "product_name", "variant_id", "variant_name")


CLEANERS = {
    "statement": clean_statement,
    "direct_checkout": clean_direct_checkout,
    "listing": clean_listing,
    "sold_order_items": clean_sold_order_items,
    "sold_orders": clean_sold_orders,
    "deposits": clean_deposits,
    "bank_transactions": clean_bank_transactions,
    "product_catalog": clean_product_catalog,
}


def clean_all(datasets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Clean every known dataset; a bank account file passes through as ``bank_account``."""
    cleaned = {k: CLEANERS[k](df) for k, df in datasets.items() if k in CLEANERS}
    if "dim_bank_account" in datasets:
        cleaned["bank_account"] = snake_case_columns(datasets["dim_bank_account"])
    return cleaned


