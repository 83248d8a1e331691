"""Session settings, and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
METHOD_LIMIT, COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", app: str = "shopledger", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench. On a cluster the session comes from the submit command."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # no call-site lookup per column expression: plans build several times faster
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one the session names, or a fresh local one where none is named."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shopledger-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system; a missing one is no error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by the hash of ``keys`` to as many tasks as the session names shuffle partitions.

    Left alone, the runtime merges partitions up to a size of packed bytes. Keys and counts pack well, and what a task sorts
    and hashes is a large multiple of that; a fixed count keeps a task's memory at its share of the rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def compiled_rows(spark: SparkSession) -> Iterator[None]:
    """While this holds, generated code stays in methods that the JVM compiles.

    The code of a wide projection is one method as long as Spark generates whole stages, and HotSpot only interprets methods
    of more than 8,000 bytes. With the limit set to that, Spark splits such a projection's code.
    """
    before = spark.conf.get(METHOD_LIMIT)
    if int(before) <= COMPILED_BYTES:
        yield
        return
    spark.conf.set(METHOD_LIMIT, str(COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, before)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While this holds, a query's shuffle files go when it ends. Else they stay until the driver's JVM collects its plan."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILE_CLEANUP) if before is None else spark.conf.set(FILE_CLEANUP, before)


def through_table(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: later branches scan the written rows.

    With a ``codec`` the table is packed by it and not by the session's: ``zstd`` for rows that would fill the disk.
    """
    path = scratch_path(df.sparkSession, name)
    with compiled_rows(df.sparkSession), shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(table: DataFrame) -> None:
    """Delete what ``through_table`` wrote for a table that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        delete_path(table.sparkSession, folder)
