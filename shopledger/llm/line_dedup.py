"""Line dedup: repeated runs of lines found by a suffix array over line ids, built by distributed prefix doubling.

A document is the sequence of its lines that hold a word. A suffix starts at each line. Ranks of suffixes by their first line
come first; then ranks by 2, 4, ... lines, each from the pair (rank here, rank half a prefix further on), until no prefix
occurs twice. On the way one length is ``min_lines`` itself (the step to it overlaps, so that any number is reached), and the
doubling goes on from there. Only suffixes whose prefix still occurs twice go on: others can begin no longer repeated run.

Ordered by rank, suffixes with a common prefix are neighbours: the suffixes of one rank at one length are an interval of the
longest-common-prefix array at that threshold. The first suffix of an interval (smallest id, then line) is the copy that stays;
every other one starts a later copy of at least that many lines. From ``min_lines`` on these windows are kept, and overlapping
and adjacent ones are merged into the maximal repeated runs of a document.

Ranks are numbered over the distinct keys of a step, in range partitions and shifted by the partitions before: no key of the
data decides how many rows a task gets. An interval's first suffix and whether it has a second come from an aggregate that is
reduced before the shuffle, so a line that a third of all rows share is one key there. Only built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, Workspace, read_table

#: What names a document: equal rows of one id are one, differing texts under one id are two.
DOCUMENT = ("doc_id", "version")
#: The least run of the query, as in its SQL twin: a line that recurs alone, between differing neighbours, stays. The pipeline
#: asks for runs from one line up.
MIN_LINES = 2


def numbered_keys(keys: DataFrame, columns: list[str], parts: int, space: Workspace) -> DataFrame:
    """``keys`` (distinct) with their rank from 0 in the order of ``columns``. Stored."""
    spark = keys.sparkSession
    ranged = space.table(keys.repartitionByRange(parts, *columns).withColumn("part", F.spark_partition_id()), "keys")
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").count().collect()):  # a row per partition
        before.append((part, total))
        total += n
    shift = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    number = F.row_number().over(Window.partitionBy("part").orderBy(*columns))
    return ranged.join(shift, "part").withColumn("rank", F.col("before") + number - 1).drop("part", "before")


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(WORD_SPACE)) != ""


def document_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, version, at, key): lines with a word, counted by ``at`` from 0; 16 bytes name a line.

    ``version`` is a hash of the text: rows that repeat an id with differing texts are documents of their own.
    """
    lines = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text_col).alias("version"),
        F.posexplode(F.filter(F.split(F.col(text_col), "\n", -1), _has_word)).alias("at", "value"),
    )
    return lines.select(*DOCUMENT, "at", F.unhex(F.md5("value")).alias("key"))


def _intervals(suffixes: DataFrame, columns: list[str], parts: int, space: Workspace) -> DataFrame:
    """Keys that begin two suffixes or more, with their rank and the first of these suffixes. Equal (id, line) is one suffix."""
    place = F.struct(*DOCUMENT, "at")
    found = suffixes.groupBy(*columns).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    return numbered_keys(found.drop("last"), columns, parts, space)


def later_windows(lines: DataFrame, min_lines: int, space: Workspace) -> DataFrame:
    """(doc_id, version, at, length): suffixes whose first ``length`` lines also start earlier, for every length of the doubling.

    ``lines`` (doc_id, version, at, key) is a stored table.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = lines.join(_intervals(lines, ["key"], parts, space), "key")
    length, found = 1, []
    while True:
        place = F.struct(*DOCUMENT, "at")
        suffixes = space.table(ranked.select(*DOCUMENT, "at", "rank", (place > F.col("first")).alias("later")).dropDuplicates([*DOCUMENT, "at"]), "suffixes")
        if suffixes.isEmpty():
            break
        if length >= min_lines:
            found.append((suffixes, length))
        space.keep(lines, *[t for t, _ in found], suffixes)
        step = length if length >= min_lines else min(length, min_lines - length)
        # the rank ``step`` lines further on, where that suffix is still there: its document is one group, sorted by line
        ahead = Window.partitionBy(*DOCUMENT).orderBy("at").rangeBetween(step, step)
        pairs = suffixes.select(*DOCUMENT, "at", F.col("rank").alias("here"), F.max("rank").over(ahead).alias("next")).filter("next is not null")
        pairs = space.table(pairs, "pairs")
        ranked = pairs.join(_intervals(pairs, ["here", "next"], parts, space), ["here", "next"])
        length += step
    windows = [t.filter("later").select(*DOCUMENT, "at", F.lit(n).alias("length")) for t, n in found]
    return reduce(DataFrame.union, windows) if windows else suffixes.select(*DOCUMENT, "at", F.lit(1).alias("length"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, runs): the maximal runs of lines that also start earlier, as array<struct<start, end>>, end excluded.

    Runs count lines with a word only, from 0; documents without a run are left out. Stored.
    """
    space = Workspace(docs.sparkSession)
    lines = space.table(document_lines(docs, id_col, text_col), "lines")
    windows = later_windows(lines, min_lines, space).withColumn("end", F.col("at") + F.col("length"))
    before = Window.partitionBy(*DOCUMENT).orderBy("at", F.desc("end"))
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opened = windows.withColumn("opens", F.when(reach >= F.col("at"), 0).otherwise(1))
    numbered = opened.withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy(*DOCUMENT, "run").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    runs = space.table(runs.groupBy(*DOCUMENT).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "runs")
    space.keep(runs)
    return runs


def without_runs(found: DataFrame) -> DataFrame:
    """``found`` (text, runs, ...) with ``lines`` and ``kept``: all lines, and those that lie in none of the runs.

    Lines without a word are in no run. Each step is a column of its own, and named twice where the next one works on its
    elements: so the optimizer computes it once a row and not once an element.
    """
    lines = found.withColumn("lines", F.split("text", "\n", -1))
    numbers = F.transform("lines", lambda x, i: F.when(_has_word(x), i))
    worded = lines.withColumn("worded", F.array_compact(numbers))
    gone = F.flatten(F.transform("runs", lambda r: F.slice("worded", r["start"] + 1, r["end"] - r["start"])))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    left = worded.withColumn("left", F.when(F.size("worded") > 0, F.array_except(every, gone)).otherwise(every))
    return left.withColumn("kept", F.when(F.size("left") > 0, F.transform("left", lambda i: F.get("lines", i))).otherwise(F.array().cast("array<string>")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``docs`` with every line deleted that lies in a run of ``min_lines`` or more lines which also starts earlier.

    Earlier: in a smaller id, or in the same document further up. Runs count lines with a word only; lines without one stay
    and do not break a run. Texts that lose nothing stay byte for byte; null texts and rows with a null id stay. Rows that
    repeat an id and its text are one document and lose the same lines; differing texts under one id are documents of their
    own, in the order of a hash. A document may become empty; it keeps its row. All columns stay, whatever they are called: rows travel as one
    struct, once.
    """
    runs = repeated_runs(docs, min_lines, id_col, text_col)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # one way at all sizes: the runs grow with the documents, so they are never sent to all tasks
    same = (F.col("row").getField(id_col) == F.col("doc_id")) & (F.xxhash64(F.col("row").getField(text_col)) == F.col("version"))
    found = packed.join(runs.hint("merge"), same, "left")
    cut = without_runs(found.select("row", F.col("row").getField(text_col).alias("text"), "runs"))
    left = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    return cut.select(*[left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines deleted, and the digest of the kept text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = repeated_runs(docs, MIN_LINES)
    named = docs.withColumn("version", F.xxhash64("text"))
    cut = without_runs(named.join(runs.hint("merge"), list(DOCUMENT), "left").withColumn("text", F.coalesce("text", F.lit(""))))
    whole = F.col("runs").isNull()
    removed = F.when(whole, 0).otherwise(F.size("lines") - F.size("kept")).cast("long")
    digest = F.sha2(F.when(whole, F.col("text")).otherwise(F.array_join("kept", "\n")), 256)
    return cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"), removed.alias("n_removed"), digest.alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE_SQL = {
    "op10_line_dedup": """
        with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        l as (
            select doc_id, unnest(lines) as value, unnest(range(len(lines))) as line from split
        ),
        w as (
            select doc_id, line, value, row_number() over (partition by doc_id order by line) as pos from l
            where regexp_matches(value, '[^\\x20\\x09-\\x0D]') and doc_id is not null
        ),
        p as (select a.doc_id, a.pos, sha256(a.value) || sha256(b.value) as run from w a join w b on b.doc_id = a.doc_id and b.pos = a.pos + 1),
        later as (select doc_id, pos from (select *, row_number() over (partition by run order by doc_id, pos) as n from p) where n > 1),
        gone as (select distinct w.doc_id, w.line from w join later x on x.doc_id = w.doc_id and w.pos - x.pos in (0, 1)),
        kept as (
            select l.doc_id, count(*) as n_lines, count(g.line) as n_removed,
                   coalesce(string_agg(l.value, chr(10) order by l.line) filter (where g.line is null), '') as text
            from l left join gone g on g.doc_id = l.doc_id and g.line = l.line group by l.doc_id
        )
        select doc_id, n_lines, n_removed, sha256(text) as kept_sha256 from kept
    """,
}
