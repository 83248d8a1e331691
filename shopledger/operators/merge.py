"""Merges of new dimension rows into stored dimensions, and key remapping of facts.

Each merge is a function of two tables to the new table. Of insert-only merges, ``sinks.append_rows`` stores the ``unseen_*``
rows alone; ``sinks.rewrite_table`` stores the result of the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CATALOG_KEY, CATALOG_NAMES, INPUT_POSITION, MERGE_KEYS
from ..functions.dates import key_date
from ..functions.text import as_col
from ..session import through_table
from .dimensions import calendar_columns, product_code
from .keys import assign_keys, first_row, keep_first, position, row_order


def _max_key(current: DataFrame, surrogate_key: str):
    return current.select(F.max(as_col(surrogate_key))).scalar()


def _number_new(new: DataFrame, business_key: str, surrogate_key: str, current: DataFrame) -> DataFrame:
    return assign_keys(new, business_key, surrogate_key, after=_max_key(current, surrogate_key), stored=True)


def unseen_rows(
    current: DataFrame,
    incoming: DataFrame,
    business_key: str,
    surrogate_key: str,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The incoming rows whose business key is not stored, one per key, numbered after the largest stored key.

    Incoming rows with a null business key are dropped; of several with the same key the first by ``order_by``, or
    else in the input files, counts. The
    rows are written once before they are numbered, so that the join and the choice do not run twice.
    """
    known = current.filter(F.col("is_current")) if "is_current" in current.columns else current
    unseen = incoming.filter(as_col(business_key).isNotNull()).join(known.select(business_key), business_key, "left_anti")
    new = unseen.select(*incoming.columns).drop(surrogate_key)
    new = keep_first(new, [business_key], list(order_by) or row_order(new, [business_key])).drop(INPUT_POSITION)
    return _number_new(through_table(new, "unseen"), business_key, surrogate_key, current)


def upsert_dimension(
    current: DataFrame,
    incoming: DataFrame,
    business_key: str,
    surrogate_key: str,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Insert-only merge: stored rows stay as they are, ``unseen_rows`` are added."""
    new = unseen_rows(current, incoming, business_key, surrogate_key, order_by)
    return current.unionByName(new, allowMissingColumns=True)


def key_mapping(incoming: DataFrame, merged: DataFrame, business_key: str, surrogate_key: str) -> DataFrame:
    """(old_key, new_key): builder keys of the incoming rows and the stored keys of the same business keys."""
    stored = merged.filter(F.col("is_current")) if "is_current" in merged.columns else merged
    stored = stored.groupBy(business_key).agg(F.max(as_col(surrogate_key)).alias("new_key"))
    old = incoming.select(as_col(business_key), as_col(surrogate_key).alias("old_key")).dropna()
    return old.join(stored, business_key).select("old_key", "new_key")


def remap_keys(fact: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace builder keys in a fact column by stored keys; unmapped keys stay."""
    names = fact.columns
    m = mapping.select(F.col("old_key").alias(column), F.col("new_key").alias("__new_key"))
    joined = fact.join(m, column, "left").withColumn(column, F.coalesce("__new_key", as_col(column)))
    return joined.select(*names)


def merge_star(stored: dict[str, DataFrame], built: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Merge the built dimensions into the stored ones and remap the built facts to the stored keys."""
    out = dict(built)
    for table, (business_key, surrogate_key, uses) in MERGE_KEYS.items():
        if table not in built or table not in stored:
            continue
        out[table] = upsert_dimension(stored[table], built[table], business_key, surrogate_key)
        mapping = key_mapping(built[table], out[table], business_key, surrogate_key)
        for fact, column in uses:
            if fact in out:
                out[fact] = remap_keys(out[fact], column, mapping)
    if "dim_time" in built and "dim_time" in stored:
        out["dim_time"] = upsert_dim_time(stored["dim_time"], built["dim_time"])
    if "dim_product_catalog" in built and "dim_product_catalog" in stored:
        out["dim_product_catalog"] = insert_catalog(stored["dim_product_catalog"], built["dim_product_catalog"])
    return out


def unseen_days(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Calendar rows whose key is not stored."""
    return incoming.join(current.select("time_key"), "time_key", "left_anti").select(*incoming.columns)


def upsert_dim_time(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add calendar rows whose key is not stored yet."""
    return current.unionByName(unseen_days(current, incoming), allowMissingColumns=True)


def ensure_dates(current: DataFrame, bank: DataFrame, column: str = "transaction_date_key") -> DataFrame:
    """Add calendar rows for date keys seen in incoming rows; keys that are no date are ignored."""
    seen = bank.select(as_col(column).alias("time_key")).filter("time_key is not null").distinct()
    days = seen.join(current.select("time_key"), "time_key", "left_anti").select(key_date("time_key").alias("day"))
    rows = days.filter("day is not null").select(*[c.alias(n) for n, c in calendar_columns(F.col("day")).items()])
    return current.unionByName(rows.select(*[c for c in rows.columns if c in current.columns]), allowMissingColumns=True)


def _unseen_accounts(current: DataFrame, accounts: DataFrame) -> DataFrame:
    incoming = accounts.filter(F.col("account_number").isNotNull())
    new = incoming.join(current.select("account_number"), "account_number", "left_anti")
    names = ["account_number", "account_name", "opening_date"]
    one = first_row(new.select(*names, *position(new)), ["account_number"])
    filled = one.withColumns(
        {
            "account_name": F.coalesce("account_name", "account_number"),
            "is_active": F.lit(True),
            "currency_code": F.lit("VND"),
            "created_date": F.current_timestamp(),
            "updated_date": F.current_timestamp(),
        }
    )
    return _number_new(through_table(filled, "unseen"), "account_number", "bank_account_key", current)


def ensure_bank_accounts(current: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add accounts that are not stored; the name defaults to the number, the currency is VND."""
    return current.unionByName(_unseen_accounts(current, accounts), allowMissingColumns=True)


def upsert_bank_accounts(current: DataFrame, accounts: DataFrame) -> DataFrame:
    """Update name and opening date of stored accounts, add the others. Of an account's rows the first in the file counts. A null opening date leaves the stored one."""
    known = accounts.filter(F.col("account_number").isNotNull())
    incoming = first_row(known.select("account_number", "account_name", "opening_date", *position(known)), ["account_number"])
    fresh = incoming.select(
        "account_number",
        F.coalesce("account_name", "account_number").alias("__name"),
        F.col("opening_date").alias("__opened"),
        F.lit(True).alias("__hit"),
    )
    updated = current.join(fresh, "account_number", "left").withColumns(
        {
            "account_name": F.coalesce("__name", "account_name"),
            "opening_date": F.coalesce("__opened", "opening_date"),
            "updated_date": F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col("updated_date")),
        }
    )
    updated = updated.select(*current.columns)
    return updated.unionByName(_unseen_accounts(current, incoming), allowMissingColumns=True)


def _catalog_rows(incoming: DataFrame) -> DataFrame:
    rows = incoming.select(*CATALOG_KEY, *CATALOG_NAMES, *position(incoming)).dropna(subset=list(CATALOG_KEY))
    return first_row(rows, CATALOG_KEY)


def _unseen_catalog(current: DataFrame, incoming: DataFrame) -> DataFrame:
    new = incoming.join(current.select(*CATALOG_KEY), list(CATALOG_KEY), "left_anti")
    new = new.withColumns(
        {
            "product_code": product_code(),
            "created_date": F.current_timestamp(),
            "updated_date": F.current_timestamp(),
            "__key": F.to_json(F.array(*CATALOG_KEY)),
        }
    )
    return _number_new(through_table(new, "unseen"), "__key", "product_catalog_key", current).drop("__key")


def unseen_catalog(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Numbered catalog rows whose natural key is not stored."""
    return _unseen_catalog(current, _catalog_rows(incoming))


def insert_catalog(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add catalog rows with unseen natural keys; stored rows stay as they are."""
    return current.unionByName(unseen_catalog(current, incoming), allowMissingColumns=True)


def insert_catalog_counts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows that ``insert_catalog`` adds and skips, and the incoming total, in one aggregate."""
    known = current.select(*CATALOG_KEY, F.lit(True).alias("known"))
    marked = _catalog_rows(incoming).join(known, list(CATALOG_KEY), "left")
    return marked.agg(
        F.count_if(F.col("known").isNull()).alias("inserted"),
        F.count("known").alias("skipped"),
        F.count("*").alias("total"),
    )


def upsert_catalog(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update the names of stored natural keys (also to null), add the others."""
    rows = _catalog_rows(incoming)
    fresh = rows.select(*CATALOG_KEY, *[F.col(c).alias(f"__{c}") for c in CATALOG_NAMES], F.lit(True).alias("__hit"))
    changes = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in CATALOG_NAMES}
    changes["updated_date"] = F.when(F.col("__hit"), F.current_timestamp()).otherwise(F.col("updated_date"))
    updated = current.join(fresh, list(CATALOG_KEY), "left").withColumns(changes).select(*current.columns)
    return updated.unionByName(_unseen_catalog(current, rows), allowMissingColumns=True)
