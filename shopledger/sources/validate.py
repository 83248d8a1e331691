"""Header checks and the duplicate-key report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BANK_DESCRIPTION_WORDS, CATALOG_HEADERS, CATALOG_KEY, HEADER_RULES
from ..functions.text import as_col, strip


def validate_columns(key: str, columns: Sequence[str]) -> list[str]:
    """Messages about missing headers; empty if all is well or the dataset is unknown. Case and outer blanks do not count."""
    present = {c.strip().lower() for c in columns}
    if key == "bank_transactions":
        if any(word in c for c in present for word in BANK_DESCRIPTION_WORDS):
            return []
        return ["missing a column that contains: " + " or ".join(BANK_DESCRIPTION_WORDS)]
    required, groups = HEADER_RULES.get(key, ([], []))
    messages = [f"missing column: {c}" for c in required if c.lower() not in present]
    for group in groups:
        if not any(c.lower() in present for c in group):
            messages.append("missing one of: " + ", ".join(group))
    return messages


def validation_report(spark: SparkSession, datasets: dict[str, DataFrame]) -> DataFrame:
    """(dataset, message) for every missing header."""
    rows = [(k, m) for k, df in datasets.items() for m in validate_columns(k, df.columns)]
    return spark.createDataFrame(rows, "dataset string, message string")


def duplicate_keys(raw_catalog: DataFrame) -> DataFrame:
    """Natural keys that occur more than once in an incoming catalog file, with their count."""
    names = {}
    for c in raw_catalog.columns:
        target = CATALOG_HEADERS.get(c.strip().lower())
        if target in CATALOG_KEY:
            names.setdefault(target, c)
    keys = raw_catalog.select(*[strip(as_col(names[k])).alias(k) for k in CATALOG_KEY])
    return keys.groupBy(*CATALOG_KEY).agg(F.count("*").alias("row_count")).filter("row_count > 1")
