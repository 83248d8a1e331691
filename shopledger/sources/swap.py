"""Replace folders of a stored table so that a stop at any point leaves the old or the new table, in full.

1. The new rows are staged beside the table, on the same file system.
2. One small file, the pending note, names the staged folder and the folders of the table that it replaces. Writing it is the
   commit: before it the table is the old one, from then on the new one.
3. The folders are moved over one by one. A folder that is no longer staged has been moved, so this can be taken up again.
4. The note goes.

``read_table`` reads a table with a pending note as the note says: the live folders that it does not name, and the staged ones.
The next writer finishes the moves first. Names that start with an underscore are not read by Spark as data.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _place(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _place(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _beside(path: str, kind: str) -> str:
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/_{kind}-{name}"


def staging_path(path: str) -> str:
    """A new folder beside a table for the rows of one rewrite."""
    return f"{_beside(path, 'staged')}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    return _files(spark, path).exists(_place(spark, path))


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_place(spark, path), True)


def pending(spark: SparkSession, path: str) -> dict | None:
    """The pending note of a table: the staged folder and the folders it replaces ("" for the whole table)."""
    note = _beside(path, "pending")
    if not exists(spark, note):
        return None
    stream = _files(spark, note).open(_place(spark, note))
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, staged: str, folders: Sequence[str]) -> None:
    """Write the pending note: from here on the table is the new one."""
    note = _beside(path, "pending")
    files, draft = _files(spark, note), f"{note}-{uuid.uuid4().hex[:12]}"
    stream = files.create(_place(spark, draft), True)
    stream.write(bytearray(json.dumps({"staged": staged, "folders": list(folders)}).encode()))
    stream.close()
    if not files.rename(_place(spark, draft), _place(spark, note)):
        raise OSError(f"another rewrite of {path} is pending")


def _move(spark: SparkSession, source: str, target: str) -> None:
    files = _files(spark, target)
    files.delete(_place(spark, target), True)
    files.mkdirs(_place(spark, target).getParent())
    if not files.rename(_place(spark, source), _place(spark, target)):
        raise OSError(f"could not move {source} to {target}")


def finish(spark: SparkSession, path: str) -> None:
    """Move what a pending note names, also what an earlier driver left; without a note nothing is to be done."""
    note = pending(spark, path)
    if note is None:
        return
    for folder in note["folders"]:
        source = f"{note['staged']}/{folder}".rstrip("/")
        if exists(spark, source):
            _move(spark, source, f"{path.rstrip('/')}/{folder}".rstrip("/"))
    delete(spark, note["staged"])
    delete(spark, _beside(path, "pending"))


def swap(spark: SparkSession, path: str, staged: str, folders: Sequence[str] = ("",)) -> None:
    """Replace the folders of a table by the staged folders of the same names."""
    commit(spark, path, staged, folders)
    finish(spark, path)


def _load(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table as of its last commit, whatever a stopped driver has left; None if there is none."""
    note = pending(spark, path)
    if note is None:
        return _load(spark, path)
    waiting = [f for f in note["folders"] if exists(spark, f"{note['staged']}/{f}".rstrip("/"))]
    if waiting == [""]:
        return _load(spark, note["staged"])
    live = _load(spark, path)
    if not waiting:
        return live
    named = [dict(part.split("=", 1) for part in folder.split("/")) for folder in waiting]

    def is_in(folder: dict[str, str]):
        return reduce(lambda a, b: a & b, [F.col(k).cast("string").eqNullSafe(v) for k, v in folder.items()])

    staged = spark.read.option("basePath", note["staged"]).parquet(*[f"{note['staged']}/{f}" for f in waiting])
    if live is None:
        return staged
    kept = live.filter(~reduce(lambda a, b: a | b, [is_in(f) for f in named]))
    # partition values are read as the types that their folders suggest
    same = [F.col(f.name).cast(f.dataType).alias(f.name) for f in live.schema if f.name in staged.columns]
    return kept.unionByName(staged.select(*same), allowMissingColumns=True)
