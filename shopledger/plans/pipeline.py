"""One period from raw files to the stored star: load, check, clean, build, merge, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FACT_KEYS
from ..operators.cleaners import clean_all
from ..operators.merge import unseen_catalog, unseen_days, unseen_rows
from ..constants import MERGE_KEYS
from ..session import through_table
from ..sources.files import load_period
from ..sources.sinks import append_rows, rewrite_months, write_fact_period, write_table
from ..sources.swap import finish, read_table
from ..sources.validate import validate_columns
from .star import build_dimensions, build_facts


def read_stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table as of its last commit, or None."""
    return read_table(spark, path)


def new_dimension_rows(stored: DataFrame, table: str, built: DataFrame) -> DataFrame:
    """The rows that this load adds to a stored dimension, which may be empty: first and later loads go one way."""
    if table == "dim_time":
        return unseen_days(stored, built)
    if table == "dim_product_catalog":
        return unseen_catalog(stored, built)
    business_key, surrogate_key, _ = MERGE_KEYS[table]
    return unseen_rows(stored, built, business_key, surrogate_key)


def clear_bank_month(spark: SparkSession, path: str, period: str) -> None:
    """Drop the stored bank rows dated in a month, whichever files they came from. Month folders hold just these rows."""
    finish(spark, path)
    if read_stored(spark, path) is not None:
        rewrite_months(spark, path, period, period, lambda rows: rows.filter(F.lit(False)))


def run_period(spark: SparkSession, raw_root: str, period: str, warehouse: str) -> dict[str, str]:
    """Load one period. Raises ValueError on missing headers. Running it again leaves the same rows.

    Facts look their keys up in the merged dimensions, so no key is remapped afterwards.
    """
    raw = load_period(spark, raw_root, period, positions=True)
    problems = {k: m for k, df in raw.items() if (m := validate_columns(k, df.columns))}
    if problems:
        raise ValueError(f"period {period}: {problems}")
    # the cleaned tables feed several dimensions and facts: each raw file is parsed once
    cleaned = {k: through_table(df, f"clean-{k}") for k, df in clean_all(raw).items()}
    paths, dims = {}, {}
    for table, built in build_dimensions(spark, cleaned).items():
        path = paths[table] = f"{warehouse.rstrip('/')}/{table}"
        finish(spark, path)
        if read_stored(spark, path) is None:
            write_table(spark.createDataFrame([], built.schema), path)
        append_rows(new_dimension_rows(spark.read.parquet(path), table, built), path)
        dims[table] = spark.read.parquet(path)
    for table, fact in build_facts(cleaned, dims, batch_id=f"period_{period}").items():
        path = paths[table] = f"{warehouse.rstrip('/')}/{table}"
        if table == "fact_bank_transactions":
            clear_bank_month(spark, path, period)
        write_fact_period(fact, path, table, period)
    return paths


def load_star(spark: SparkSession, warehouse: str, tables=None) -> dict[str, DataFrame]:
    """The stored star tables that exist."""
    names = tables or ["dim_time", "dim_product_catalog", *MERGE_KEYS, *FACT_KEYS]
    found = {t: read_stored(spark, f"{warehouse.rstrip('/')}/{t}") for t in names}
    return {t: df for t, df in found.items() if df is not None}
