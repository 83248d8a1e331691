"""Deterministic "first row" and dense surrogate keys without a one-partition sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import INPUT_POSITION
from ..functions.text import as_col
from ..session import through_table


def row_order(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """What "first" means in a table: the place in the input files where the reader noted it, else all columns but the keys."""
    return [INPUT_POSITION] if INPUT_POSITION in df.columns else [c for c in df.columns if c not in keys]


def position(df: DataFrame) -> list[Column]:
    """The input position of a table, for a projection; nothing where it has none."""
    return [F.col(INPUT_POSITION)] if INPUT_POSITION in df.columns else []


def first_row(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row per key by ``row_order``; the position goes."""
    return keep_first(df, keys, row_order(df, keys)).drop(INPUT_POSITION)


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the smallest by ``order_by``, ties by the other columns. Without an order there is no first row.

    An aggregate, not a window: rows of a hot key are reduced before the shuffle.
    """
    order = [c for c in order_by if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    others = order + rest
    if not others:
        return df.select(*keys).distinct()
    if not order:
        raise ValueError(f"which row of a key {list(keys)} is the first? No order is given")
    best = df.groupBy(*[as_col(k) for k in keys]).agg(F.min(F.struct(*[as_col(c) for c in others])).alias("best"))
    return best.select(*keys, "best.*").select(*df.columns)


def key_bucket(business_key: Column, hex_digits: int = 3) -> Column:
    """Leading hex digits of the key's md5: spreads distinct keys evenly, whatever they look like."""
    return F.substring(F.md5(business_key.cast("string").cast("binary")), 1, hex_digits)


def assign_keys(
    df: DataFrame, business_key: str, surrogate_key: str, after: Column | None = None, hex_digits: int = 3, stored: bool = False
) -> DataFrame:
    """Dense keys 1..n (or ``after``+1..) over unique, non-null business keys, ordered by (md5 bucket, key).

    Rows are numbered inside 16**hex_digits buckets in parallel; the bucket offsets come from a count per bucket, at most
    16**hex_digits rows. The same rows always get the same keys, also when a lost executor's work is redone. The rows are
    counted and numbered, so they are written once before, unless they are ``stored``: what they come from runs once.
    """
    rows = df.withColumn("__bucket", key_bucket(as_col(business_key), hex_digits))
    rows = rows if stored else through_table(rows, "keyed")
    sizes = rows.groupBy("__bucket").agg(F.count("*").alias("n"))
    # at most 16**hex_digits rows reach this window
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(W.partitionBy("__bucket").orderBy(as_col(business_key)))
    start = F.lit(0) if after is None else F.coalesce(after, F.lit(0))
    numbered = rows.withColumn("__row", inside).join(F.broadcast(offsets), "__bucket")
    key = (F.col("__row") + F.col("__offset") + start).cast("bigint").alias(surrogate_key)
    return numbered.select(key, *[as_col(c) for c in df.columns if c != surrogate_key])
