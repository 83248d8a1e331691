"""Bank account reports, catalog and bank browsing. Every sort ends in a key, so pages do not overlap."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_col
from ..operators.filters import date_filter, valid_date
from ..session import drop_table, through_table

CENTS = "decimal(20,2)"


def _or_zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0).cast("decimal(15,2)"))


def _has_number() -> Column:
    return F.col("account_number").isNotNull() & (F.col("account_number") != "")


#: A sort: (column, descending) each. Nulls come last ascending and first descending, as the largest value.
Order = Sequence[tuple[str, bool]]


def sort_columns(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_last() for c, down in order]


def after_row(order: Order, last: Sequence) -> Column:
    """True for rows that sort behind the one with the values ``last``: the seek predicate of the next page."""
    behind, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(order, last, strict=True):
        c = F.col(name)
        if value is None:
            beyond = c.isNotNull() if down else F.lit(False)
        else:
            beyond = F.coalesce(c < F.lit(value), F.lit(False)) if down else c.isNull() | (c > F.lit(value))
        behind = behind | (equal & beyond)
        equal = equal & c.eqNullSafe(F.lit(value))
    return behind


def page(rows: DataFrame, order: Order, limit: int | None, offset: int = 0, after: Sequence | None = None) -> DataFrame:
    """``limit`` rows of ``rows`` in an order that ends in a key: from the start, behind the row ``after``, or at ``offset``.

    A page from the start or behind a row is a top-n of each task. A page at an offset is found by the sort columns alone: they
    are dealt by range and written, a count per range tells which ranges hold the page, and only these are numbered; the rows
    themselves are then looked up by their sort columns. No task sees more than its range, and no range before the page is sorted.
    """
    if after is not None:
        rows = rows.filter(after_row(order, after))
    if offset:
        spark, names = rows.sparkSession, [c for c, _ in order]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = rows.select(*names).repartitionByRange(parts, *sort_columns(order)).withColumn("__part", F.spark_partition_id())
        keys = through_table(keys, "page-keys")
        chosen, before = [], 0
        for part, n in sorted(tuple(r) for r in keys.groupBy("__part").count().collect()):  # a row per range
            if before + n > offset and (limit is None or before < offset + limit):
                chosen.append((part, before))
            before += n
        starts = spark.createDataFrame(chosen, "__part int, __before bigint")
        number = F.row_number().over(Window.partitionBy("__part").orderBy(*sort_columns(order))) + F.col("__before")
        wanted = F.col("__number") > offset
        if limit is not None:
            wanted = wanted & (F.col("__number") <= offset + limit)
        found = keys.join(starts, "__part").withColumn("__number", number).filter(wanted).select(*[F.col(c).alias(f"__{c}") for c in names])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
        return rows.join(found, same, "left_semi").orderBy(*sort_columns(order))
    rows = rows.orderBy(*sort_columns(order))
    return rows if limit is None else rows.limit(limit)


def bank_account_summary(bank, accounts, dim_time, limit: int | None = 100, offset: int = 0, latest: bool = False) -> DataFrame:
    """Per account: transactions, credit, debit, largest balance, first and last date; by credit descending.

    With ``latest`` also the balance after the last row by date and key, which is what the account holds.
    """
    last = F.struct("full_date", "bank_transaction_key")
    known = F.col("balance_after_transaction").isNotNull()
    balance = [F.max_by("balance_after_transaction", F.when(known, last)).cast(CENTS).alias("latest_balance")] if latest else []
    stats = (
        date_filter(bank, dim_time, "transaction_date_key", attributes=["full_date"])
        .groupBy("bank_account_key")
        .agg(
            F.count("*").alias("total_transactions"),
            F.sum(_or_zero("credit_amount")).cast(CENTS).alias("total_credit"),
            F.sum(_or_zero("debit_amount")).cast(CENTS).alias("total_debit"),
            F.max("balance_after_transaction").cast(CENTS).alias("current_balance"),
            F.min("full_date").alias("first_transaction_date"),
            F.max("full_date").alias("last_transaction_date"),
            *balance,
        )
    )
    attributes = ["account_number", "account_name", "cif_number", "customer_address", "opening_date", "currency_code"]
    named = accounts.filter(_has_number()).select("bank_account_key", *attributes)
    out = stats.join(named, "bank_account_key")
    columns = [c for c in stats.columns if c != "bank_account_key"]
    cut = page(out.select(*attributes, *columns, "bank_account_key"), [("total_credit", True), ("account_number", False), ("bank_account_key", False)], limit, offset)
    return cut.drop("bank_account_key")


def bank_account_count(accounts) -> DataFrame:
    return accounts.filter(_has_number()).agg(F.count_distinct("bank_account_key").alias("total"))


def bank_account_info(accounts, account_number: str | None = None) -> DataFrame:
    """Attributes of one account, or of all; null reads 'N/A', a null currency 'VND'."""
    rows = accounts if account_number is None else accounts.filter(F.col("account_number") == account_number)
    names = ("account_name", "account_number", "cif_number", "customer_address", "opening_date")
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in names]
    return rows.select(*shown, F.coalesce("currency_code", F.lit("VND")).alias("currency_code"))


def account_statement(
    bank, accounts, dim_time, account_number: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bank rows of an account (or of all) by date and key; null amounts read 0; a malformed bound is ignored."""
    if account_number is not None:
        accounts = accounts.filter(F.col("account_number") == account_number)
    rows = date_filter(bank, dim_time, "transaction_date_key", valid_date(start), valid_date(end), ["full_date"])
    named = accounts.select(
        "bank_account_key", F.col("account_number").alias("statement_account"), "account_name", "opening_date"
    )
    out = rows.join(named, "bank_account_key").orderBy("full_date", "bank_transaction_key")
    return out.select(
        F.col("full_date").alias("transaction_date"),
        "reference_number",
        F.col("statement_account").alias("account_number"),
        "account_name",
        "opening_date",
        _or_zero("credit_amount").alias("credit_amount"),
        _or_zero("debit_amount").alias("debit_amount"),
        F.col("balance_after_transaction").alias("balance"),
        F.col("transaction_description").alias("description"),
    )


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def any_like(columns: Sequence[str], text: str) -> Column:
    """True if one of the columns, read as text, holds the text, whatever its case; % and _ are wildcards."""
    return _any([as_col(c).cast("string").ilike(f"%{text}%") for c in columns])


def any_contains(columns: Sequence[str], text: str) -> Column:
    """As ``any_like``, but the text is taken literally."""
    return _any([F.lower(as_col(c).cast("string")).contains(text.lower()) for c in columns])


CATALOG_SEARCH = (
    "product_line_id",
    "product_id",
    "variant_id",
    "product_line_name",
    "product_name",
    "variant_name",
    "product_code",
)
CATALOG_COLUMNS = ("product_catalog_key", *CATALOG_SEARCH, "created_date", "updated_date")


def search_catalog(catalog, search: str | None = None) -> DataFrame:
    return catalog.filter(any_like(CATALOG_SEARCH, search)) if search else catalog


def browse_catalog(
    catalog, search=None, sort_by=None, sort_order="asc", limit: int | None = 100, offset: int = 0, after: Sequence | None = None
) -> DataFrame:
    """One page of the catalog. An unknown sort column is ignored. ``after``: the sort values of the last row seen."""
    rows = search_catalog(catalog, search)
    present = [c for c in CATALOG_COLUMNS if c in rows.columns]
    return page(rows.select(*present), catalog_order(sort_by, sort_order), limit, offset, after)


def catalog_order(sort_by=None, sort_order="asc") -> Order:
    order = [("product_catalog_key", False)]
    if sort_by in CATALOG_COLUMNS and sort_by != "product_catalog_key":
        order.insert(0, (sort_by, sort_order.lower() == "desc"))
    elif sort_by == "product_catalog_key":
        order = [(sort_by, sort_order.lower() == "desc")]
    return order


def catalog_count(catalog, search=None) -> DataFrame:
    return search_catalog(catalog, search).agg(F.count("*").alias("total"))


BANK_SEARCH = ("transaction_description", "reference_number", "account_number")
BANK_SORT = (
    "transaction_date",
    "reference_number",
    "account_number",
    "credit_amount",
    "debit_amount",
    "balance_after_transaction",
    "transaction_description",
    "pl_account_number",
)
PARSED = {
    "parsed_product_line_id": "product_line_id",
    "parsed_product_id": "product_id",
    "parsed_variant_id": "variant_id",
}
NAMES = ("product_line_name", "product_name", "variant_name")
_BROWSED = (
    "bank_transaction_key",
    "bank_account_key",
    "product_catalog_key",
    *BANK_SORT,
    *PARSED,
    "is_business_related",
)


def search_bank(bank, search=None, account_number=None) -> DataFrame:
    rows = bank
    if account_number is not None:
        rows = rows.filter(F.col("account_number") == account_number)
    return rows.filter(any_like(BANK_SEARCH, search)) if search else rows


def bank_transaction_count(bank, search=None, account_number=None) -> DataFrame:
    return search_bank(bank, search, account_number).agg(F.count("*").alias("total"))


def bank_order(sort_by=None, sort_order="desc") -> Order:
    """By a known column and the key, else the newest first."""
    if sort_by in BANK_SORT:
        return [(sort_by, sort_order.lower() == "desc"), ("bank_transaction_key", False)]
    return [("transaction_date", True), ("bank_transaction_key", True)]


def _goes_to_every_task(lookup: DataFrame) -> bool:
    """True if the planner broadcasts this side of a join: the rows of the other side are not shuffled for it."""
    size = lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    spark = lookup.sparkSession
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return int(str(size)) <= spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most)


def browse_bank_transactions(
    bank,
    accounts,
    catalog,
    dim_time,
    search=None,
    account_number=None,
    sort_by=None,
    sort_order="desc",
    limit: int | None = 100,
    offset: int = 0,
    after: Sequence | None = None,
) -> DataFrame:
    """One page of bank rows with date, account name and product names (by catalog key, else by the parsed ids).

    ``after``: the values that the last row seen has in the columns of ``bank_order``; the page starts behind it.

    The lookups have one row per key and do not change the row count, so the page is cut before them: they are joined to
    ``limit`` rows, not to the fact. Without a limit all rows are joined; where that shuffles them, what is read, and what is
    named, is written and the shuffle files before it go, so that the disk never holds the shuffles of all steps.
    """
    rows = date_filter(search_bank(bank, search, account_number), dim_time, "transaction_date_key", attributes=["full_date"], how="left")
    rows = rows.withColumnRenamed("full_date", "transaction_date")
    order = bank_order(sort_by, sort_order)
    by_key = catalog.select("product_catalog_key", *[F.col(c).alias(f"key_{c}") for c in NAMES])
    by_ids = catalog.select(
        *[F.col(c).alias(p) for p, c in PARSED.items()], *[F.col(c).alias(f"ids_{c}") for c in NAMES]
    )
    whole = limit is None and not offset and not (_goes_to_every_task(by_key) and _goes_to_every_task(by_ids))
    if whole:
        rows = rows if after is None else rows.filter(after_row(order, after))
        cut = through_table(rows.select(*_BROWSED), "bank-rows", "zstd")
    else:
        cut = page(rows, order, limit, offset, after)
    out = cut.join(accounts.select("bank_account_key", "account_name"), "bank_account_key", "left")
    names = [F.coalesce(f"key_{c}", f"ids_{c}").alias(c) for c in NAMES]
    if whole:
        # names are looked up once per set of ids: the rows themselves go through one join, and rows without a key are not one group
        ids = ("product_catalog_key", *PARSED)
        products = cut.select(*ids).distinct().join(by_key, "product_catalog_key", "left").join(by_ids, list(PARSED), "left")
        products = products.select(*[F.col(c).alias(f"__{c}") for c in ids], *names)
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ids])
        read = [c for c in _BROWSED if c not in ("bank_account_key", "product_catalog_key")]
        out = through_table(out.join(products, same, "left").select(*read, "account_name", *NAMES), "bank-named", "zstd")
        drop_table(cut)
    else:
        out = out.join(by_key, "product_catalog_key", "left").join(by_ids, list(PARSED), "left").select("*", *names)
    # sorted before null amounts read 0: they sort as nulls
    return out.orderBy(*sort_columns(order)).select(
        "bank_transaction_key",
        "transaction_date",
        "reference_number",
        "account_number",
        "account_name",
        "transaction_description",
        "pl_account_number",
        *PARSED,
        *NAMES,
        _or_zero("credit_amount").alias("credit_amount"),
        _or_zero("debit_amount").alias("debit_amount"),
        "balance_after_transaction",
        "is_business_related",
    )


def filter_accounts(summary: DataFrame, search: str | None = None, currency: str | None = None) -> DataFrame:
    """Accounts whose number or name holds the text, of one currency."""
    rows = summary.filter(any_contains(("account_number", "account_name"), search)) if search else summary
    return rows.filter(F.col("currency_code") == currency) if currency else rows


def filter_any_column(df: DataFrame, search: str | None = None) -> DataFrame:
    """Rows with the text in any column."""
    return df.filter(any_contains(df.columns, search)) if search else df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-blank values of a column, for a filter list."""
    values = df.select(as_col(column).alias("value")).filter(F.col("value").isNotNull() & (F.col("value") != ""))
    return values.distinct().orderBy("value")
