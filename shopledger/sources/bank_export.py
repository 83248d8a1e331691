"""Bank exports: some preamble rows, then the header row, then the data. Files of one load may have different layouts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BANK_HEADER_WORDS, INPUT_POSITION
from ..session import through_table
from .files import input_position, text_schema

# A cell behind a comma: quoted, with doubled quotes and line breaks inside, or plain.
_CELL = r',("(?:[^"]++|"")*+"|[^,]*)'


def record_cells(record: Column) -> Column:
    """All cells of a CSV record, however many; an empty cell is null."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.transform(plain, lambda c: F.nullif(c, F.lit("")))


# A record with a plain cell, or with a quoted one without quotes and commas inside: it is not blank.
_PLAINLY_FILLED = r'(?:^|,)(?:[^",]|"[^",]+")'


def read_records(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """(file, place, cells) of every record that is not blank, in one scan.

    The schema has one column, so a record of several cells is given whole in the column for records that do not fit it.
    Quoted line breaks need ``multi_line``, which reads each file in one task.
    """
    options = {"header": False, "quote": '"', "escape": '"', "encoding": "UTF-8", "multiLine": multi_line, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "record"}
    rows = spark.read.schema(text_schema(["only", "record"])).options(**options).csv(paths)
    cells = F.when(F.col("record").isNull(), F.array(F.nullif("only", F.lit("")))).otherwise(record_cells(F.col("record")))
    # the filter is run below the projection, on cells of its own: most records need none of them there
    filled = F.when(F.col("record").rlike(_PLAINLY_FILLED), F.lit(True)).otherwise(F.exists(cells, lambda c: c.isNotNull()))
    return rows.filter(filled).select(F.col("_metadata.file_path").alias("file"), input_position().alias("place"), cells.alias("cells"))


def header_rows(records: DataFrame) -> DataFrame:
    """(file, head_place, names): the first record of each file whose text contains a known word, else its first record."""
    line = F.lower(F.array_join("cells", " "))
    is_header = reduce(lambda a, b: a | b, [line.contains(w) for w in BANK_HEADER_WORDS])
    # part and file of a place are the same in all records of a file: start and row decide, two numbers that hash aggregates
    # compare in place. The cells of the one record follow by a join; an aggregate over them would sort all records.
    start, row = F.col("place.start"), F.col("place.row")
    blocks = records.groupBy("file", start.alias("start")).agg(F.min(F.when(is_header, row)).alias("marked"), F.min(row).alias("first"))
    firsts = blocks.groupBy("file").agg(
        F.min(F.when(F.col("marked").isNotNull(), F.struct("start", F.col("marked").alias("row")))).alias("marked"),
        F.min(F.struct("start", F.col("first").alias("row"))).alias("first"),
    )
    head = F.coalesce("marked", "first")
    heads = firsts.select("file", head["start"].alias("start"), head["row"].alias("row"))
    found = records.withColumns({"start": start, "row": row}).join(F.broadcast(heads), ["file", "start", "row"])
    return found.select("file", F.col("place").alias("head_place"), F.col("cells").alias("names"))


def read_bank_export(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True, positions: bool = False) -> DataFrame:
    """Data rows under the header row of each file; the columns are those of all headers, absent ones are null.

    The files are parsed once and the records stored with their places, so that header and data rows are told apart by what
    was written and not by a second scan. A row takes the places of its file's header: an array of cell numbers in the order
    of the output columns, one row per file. Only the distinct column names come to the driver. Of equal names in a header
    the first counts. A cell behind the header's last column is an error, a shorter row is filled with null. With
    ``positions`` rows carry their place in the input.
    """
    records = through_table(read_records(spark, paths, multi_line), "bank-records", "zstd")
    heads = through_table(header_rows(records), "bank-headers")
    named = heads.select(F.posexplode("names").alias("at", "name")).filter("name is not null").groupBy("name").agg(F.min("at").alias("at"))
    columns = [r.name for r in named.orderBy("at", "name").collect()]
    places = F.array(*[F.array_position("names", F.lit(n)).cast("int") - 1 for n in columns]) if columns else F.array().cast("array<int>")
    layouts = heads.select("file", "head_place", F.size("names").alias("width"), places.alias("places"))
    body = records.join(layouts, "file").filter(F.col("place") > F.col("head_place"))
    # sizes first: later filters are run below this projection, with the test repeated for every cell they look at
    beyond = (F.size("cells") > F.col("width")) & F.exists(F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells") - F.col("width"), F.lit(0))), lambda c: c.isNotNull())
    message = F.concat(F.lit("a row has more cells than the header of "), F.col("file"))
    checked = F.when(beyond, F.raise_error(message).cast("array<string>")).otherwise(F.col("cells"))
    rows = body.select(checked.alias("cells"), "places", "place")
    values = [F.get("cells", F.col("places")[k]).alias(n) for k, n in enumerate(columns)]
    return rows.select(*values, *([F.col("place").alias(INPUT_POSITION)] if positions else []))
