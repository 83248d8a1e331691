"""Dimension versions that close: an extension beside the insert-only merges.

A stored row is one version of a business key, valid from ``effective_date`` up to, not including, ``expiry_date``. A load
compares a hash of the tracked attributes: a changed key closes its current version at the day of the load and opens a new
one. Facts find the version of their own day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import OPEN_END
from ..functions.text import as_col
from .keys import assign_keys, first_row

#: Validity of versions that were there from the start.
OPEN_START = "1900-01-01"


def tracked_hash(tracked: Sequence[str]) -> Column:
    """A hash of the tracked attributes; null and text never read alike."""
    return F.md5(F.to_json(F.struct(*[as_col(c) for c in tracked]), {"ignoreNullFields": "false"}))


def _open(rows: DataFrame, tracked: Sequence[str], since: str) -> DataFrame:
    return rows.withColumns(
        {
            "row_hash": tracked_hash(tracked),
            "effective_date": F.lit(since).cast("date"),
            "expiry_date": F.lit(OPEN_END).cast("date"),
            "is_current": F.lit(True),
        }
    )


def first_versions(incoming: DataFrame, business_key: str, surrogate_key: str, tracked: Sequence[str], since: str = OPEN_START) -> DataFrame:
    """The first load: one open version per key; of several rows of a key the first counts, a null key is dropped."""
    rows = first_row(incoming.filter(as_col(business_key).isNotNull()), [business_key])
    return assign_keys(_open(rows, tracked, since), business_key, surrogate_key)


def merge_versions(stored: DataFrame, incoming: DataFrame, business_key: str, surrogate_key: str, tracked: Sequence[str], day: str) -> DataFrame:
    """The stored versions after a load of ``day``.

    One join of the current versions with the incoming rows decides: changed keys are closed and opened anew, unseen keys are
    opened, all else stays. Closed versions are carried over untouched. Loading the same rows again changes nothing; a key that
    is changed twice on one day keeps the last state and leaves an empty validity behind. New versions are numbered after the
    largest stored key.
    """
    rows = first_row(incoming.filter(as_col(business_key).isNotNull()), [business_key])
    fresh = _open(rows, tracked, day)
    marked = stored.filter("is_current").join(fresh.select(business_key, F.col("row_hash").alias("__new_hash")), business_key, "left")
    changed = F.col("__new_hash").isNotNull() & (F.col("__new_hash") != F.col("row_hash"))
    kept = marked.withColumns(
        {
            "expiry_date": F.when(changed, F.lit(day).cast("date")).otherwise(F.col("expiry_date")),
            "is_current": ~changed,
        }
    ).select(*stored.columns)
    current = stored.filter("is_current").select(business_key, F.col("row_hash").alias("__old_hash"))
    opened = fresh.join(current, business_key, "left").filter(~F.col("__old_hash").eqNullSafe(F.col("row_hash"))).drop("__old_hash")
    top = stored.select(F.max(as_col(surrogate_key))).scalar()
    numbered = assign_keys(opened, business_key, surrogate_key, after=top)
    return stored.filter("not is_current").unionByName(kept).unionByName(numbered.select(*stored.columns))


def version_of(fact: DataFrame, versions: DataFrame, business_key: str, day: str, columns: Sequence[str]) -> DataFrame:
    """``fact`` with ``columns`` of the version that was valid on its ``day``; null where there is none.

    An equality join on the key; the validity is tested on its matches, of which one holds at most.
    """
    known = versions.select(as_col(business_key).alias("__key"), "effective_date", "expiry_date", *columns)
    valid = (F.col(day) >= F.col("effective_date")) & (F.col(day) < F.col("expiry_date"))
    joined = fact.join(known, (as_col(business_key) == F.col("__key")) & valid, "left")
    return joined.select(*fact.columns, *columns)
