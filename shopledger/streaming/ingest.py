"""Incremental ingest: file streams of one dataset or into the whole star, and the batch form that skips an unchanged period."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FILE_PATTERNS
from ..plans.pipeline import run_period
from ..sources.files import list_files, resolve_files, text_schema


def file_stream(
    spark: SparkSession, root: str, dataset: str, columns: Sequence[str], max_files: int | None = None, multi_line: bool = True
) -> DataFrame:
    """Stream of the CSV files of one dataset in all period folders, all text, with the period they lie in.

    Quoted line breaks need ``multi_line``, which reads each file in one task.
    """
    pattern = next(p for p, key in FILE_PATTERNS if key == dataset)
    reader = spark.readStream.schema(text_schema(columns)).options(
        header=True, quote='"', escape='"', multiLine=multi_line, encoding="UTF-8", enforceSchema=False
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # the folder pattern leaves out staged and hidden files
    glob = f"{root.rstrip('/')}/*/*{pattern}*" if not pattern.endswith(".csv") else f"{root.rstrip('/')}/*/*{pattern}"
    rows = reader.csv(glob)
    return rows.withColumn("period", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{4}-\d{2})/", 1))


def ingest_files(
    spark: SparkSession,
    root: str,
    dataset: str,
    columns: Sequence[str],
    target: str,
    checkpoint: str,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    max_files: int | None = None,
) -> None:
    """Read the files not seen before, transform them and store them; return when all are done.

    Each micro-batch owns the folder ``batch=<id>`` of the target and overwrites it: a batch that is retried after a
    failure does not double its rows.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch_id}")

    query = (
        file_stream(spark, root, dataset, columns, max_files)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _log(spark: SparkSession, log_path: str) -> DataFrame:
    try:
        return spark.read.parquet(log_path)
    except AnalysisException:
        return spark.createDataFrame([], "period string, name string, length bigint, loaded_at timestamp")


def snapshot(spark: SparkSession, root: str, period: str) -> DataFrame:
    """(period, name, length) of the files that a load of the period would read."""
    chosen = [p for paths in resolve_files(spark, root, period).values() for p in paths]
    files = list_files(spark, root, period)
    return files.filter(F.col("path").isin(chosen)).select("period", "name", "length")


def changed_files(current: DataFrame, log: DataFrame) -> DataFrame:
    """Files that are new or whose size differs from the last logged load."""
    return current.join(log.select("period", "name", "length"), ["period", "name", "length"], "left_anti")


def is_unchanged(current: DataFrame, log: DataFrame, period: str) -> bool:
    """True if the period was loaded before from exactly these files: none added, resized or removed."""
    old = log.filter(F.col("period") == period).select("period", "name", "length")
    if old.isEmpty():
        return False
    return current.exceptAll(old).isEmpty() and old.exceptAll(current).isEmpty()


def run_period_if_changed(
    spark: SparkSession, raw_root: str, period: str, warehouse: str, log_path: str, force: bool = False
) -> bool:
    """Run the period's load unless its files are as they were at the last load; True if it ran."""
    current = snapshot(spark, raw_root, period)
    if not force and is_unchanged(current, _log(spark, log_path), period):
        return False
    run_period(spark, raw_root, period, warehouse)
    entry = current.drop("period").withColumn("loaded_at", F.current_timestamp())
    entry.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{log_path.rstrip('/')}/period={period}")
    return True


LEDGER_SCHEMA = "period string, name string, length bigint"


def _ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(batch, period, name, length): the files of every batch whose periods are in the star."""
    try:
        return spark.read.parquet(ledger)
    except AnalysisException:
        return spark.createDataFrame([], f"{LEDGER_SCHEMA}, batch bigint")


def load_batch(spark: SparkSession, raw_root: str, files: DataFrame, batch_id: int, warehouse: str, ledger: str) -> list[str]:
    """One micro-batch into the star: load the periods that its files belong to; return them. A batch in the ledger is skipped.

    A period's tables need all its datasets together (facts join orders, payments and items), so a new file loads its period
    again, whatever part of it came before. Each table takes that at most once: dimensions get unseen keys only, a fact's
    period folder is swapped as a whole. So a batch that stopped anywhere, or is delivered again, leaves what one run leaves.
    The ledger entry is written last and in a folder of its own.
    """
    if not _ledger(spark, ledger).filter(F.col("batch") == batch_id).isEmpty():
        return []
    named = files.select("period", "name", "length").filter(F.col("period") != "").distinct()
    periods = [r.period for r in named.select("period").distinct().orderBy("period").collect()]  # a row per period folder
    for period in periods:
        run_period(spark, raw_root, period, warehouse)
    named.write.mode("overwrite").parquet(f"{ledger.rstrip('/')}/batch={batch_id}")
    return periods


def stream_star(spark: SparkSession, raw_root: str, warehouse: str, checkpoint: str, ledger: str, max_files: int | None = None) -> None:
    """Load the star from the files that came since the last run, and return when all are in it.

    The stream lists files and does not read them: it carries their names and sizes, and each batch loads the periods they
    name. ``max_files`` bounds a batch. Stored star tables equal those of ``run_period`` over the same periods in that order.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    found = reader.load(f"{raw_root.rstrip('/')}/*/*").select("path", "length")
    parts = F.regexp_extract("path", r"/(\d{4}-\d{2}/[^/]+)", 1)
    files = found.select(F.substring_index(parts, "/", 1).alias("period"), F.substring_index(parts, "/", -1).alias("name"), "length")

    def store(batch: DataFrame, batch_id: int) -> None:
        load_batch(batch.sparkSession, raw_root, batch, batch_id, warehouse, ledger)

    query = files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
