"""N-gram Jaccard join by vertical partitioning of a global n-gram order.

Order. N-grams (word shingles, named by 64-bit hashes) are ordered by (frequent or not, hash): those in many documents last. An
n-gram is frequent if its cell of a count sketch over the whole corpus is well above the mean cell. Any total order gives the
same result; this one keeps common passages out of the prefixes.

Candidates. Documents with equal sets become one class, known by its smallest id. If two sets link, their prefixes in the
global order share an n-gram. Of the documents that share a prefix n-gram, the first holds it for the others. Each document is
tested against the one first holder that it meets most often, then against its other first holders that are not in its
component yet. What these links connect needs no further pairs; then every pair that shares a prefix n-gram and is still in
two components is tested as well. So no link between different texts is lost, and no group of near copies is expanded into its pairs.

Counting. The order is cut into fragments. Each candidate set is cut with it, the overlaps of a pair are counted fragment by
fragment, and their sum decides: 100 * overlap >= percent * (size + size - overlap).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_pass, read_table, ship_package
from .components import components

WORDS = 4
PERCENT = 85
#: Cells of the count sketch; also bounds what goes to every task (a bit each).
CELLS = 1 << 22
#: A cell is frequent at so many times the mean count, and at this count at least.
FREQUENT_TIMES, FREQUENT_LEAST = 4, 64
#: Fragments of each half (rare, frequent) of the order.
FRAGMENTS = 4
#: Candidate ids up to this number go to every task that cuts sets; more are joined by a shuffle.
BROADCAST_IDS = 500_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def hash_words(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def hash_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= _MIX[0]
        out ^= out >> np.uint64(29)
        out += hashes[i : i + n]
    out ^= out >> np.uint64(30)
    out *= _MIX[1]
    out ^= out >> np.uint64(27)
    out *= _MIX[2]
    return out ^ (out >> np.uint64(31))


def lower_ascii(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and all else as it is."""
    return text.encode().lower().split() if text else []


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingle hashes, sorted; a text with fewer words is one shingle, one without words has none."""
    words = lower_ascii(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(hash_windows(hash_words(words), size))


def cell_of(grams: np.ndarray, cells: int) -> np.ndarray:
    return (grams % np.uint64(cells)).astype(np.int64)


def frequent_cells(docs: DataFrame, text_col: str, size: int, cells: int) -> np.ndarray:
    """A bit per cell, packed: counts of all documents' shingles above the bound."""
    chunk = max(1, cells // 16)
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                np.add.at(counts, cell_of(shingles(text, size), cells), 1)
        parts = [counts[a : a + chunk] for a in range(0, cells, chunk)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "counts": pa.array([zlib.compress(p.tobytes(), 1) for p in parts])})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), np.uint32)
                sums[part] = sums[part] + counts if part in sums else counts.astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "total": pa.array([int(s.sum()) for s in sums.values()]), "counts": pa.array([zlib.compress(np.minimum(s, 2**31).astype(np.uint32).tobytes(), 1) for s in sums.values()])})

    counted = docs.select(text_col).mapInArrow(count, "part int, counts binary")
    summed = counted.repartition(16, "part").mapInArrow(add, "part int, total long, counts binary").collect()  # one array of cells
    bound = max(FREQUENT_LEAST, FREQUENT_TIMES * sum(r["total"] for r in summed) / cells)
    flags = np.zeros(cells, bool)
    for r in summed:
        found = np.frombuffer(zlib.decompress(r["counts"]), np.uint32) >= bound
        flags[r["part"] * chunk : r["part"] * chunk + len(found)] = found
    return np.packbits(flags)


def in_order(grams: np.ndarray, flags: np.ndarray, cells: int) -> tuple[np.ndarray, int]:
    """``grams`` in the global order, and how many of them are rare."""
    at = cell_of(grams, cells)
    frequent = (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return np.concatenate([grams[~frequent], grams[frequent]]), int((~frequent).sum())


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, cells: int = CELLS) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of ``docs``.

    ``n_links``: tested links of the document's class to other classes. A null or empty text has no shingles and stays alone,
    as does a row with a null id. Rows that repeat an id are one document. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    flags = spark.sparkContext.broadcast(frequent_cells(rows, "text", words, cells))

    def describe(ids, texts):
        for doc, text in zip(ids, texts, strict=True):
            grams = shingles(text, words)
            n = len(grams)
            ordered, _ = in_order(grams, flags.value, cells)
            prefix = ordered[: n - (percent * n + 99) // 100 + 1] if n else ordered
            yield doc, n, xxhash.xxh3_128_digest(grams.tobytes()) if n else None, prefix.view(np.int64).tolist()

    space = Workspace(spark)
    sets = space.table(arrow_pass(rows, describe, "doc_id long, n long, set_key binary, prefix array<long>"), "sets")
    known = sets.filter("n > 0 and doc_id is not null")
    classes = space.table(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    # rows that are not the first of their class drop out before any prefix is shuffled
    copies = space.table(known.join(classes.select("set_key", "rep"), "set_key").filter("doc_id <> rep").select("doc_id"), "copies")
    side = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    firsts = known.join(side, "doc_id", "left_anti").select(F.col("doc_id").alias("rep"), "n", "prefix")

    each = firsts.select("rep", "n", F.posexplode("prefix").alias("at", "gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("holders"), F.min(F.struct("rep", "n", "at")).alias("first")).filter("holders > 1")
    buckets = space.table(each.join(shared, "gram").select("gram", "rep", "n", "at", "first"), "buckets")
    # sizes that can link, and a place in both prefixes from which the overlap can still be reached
    reach = "(100 + {p}) * least(a_n - a_at, b_n - b_at) >= {p} * (a_n + b_n)".format(p=percent)
    near = f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) and {reach}"
    stars = buckets.filter("rep <> first.rep").select(F.col("first.rep").alias("a"), F.col("rep").alias("b"), F.col("first.n").alias("a_n"), F.col("n").alias("b_n"), F.col("first.at").alias("a_at"), F.col("at").alias("b_at"))
    pairs = space.table(stars.filter(near).groupBy("a", "b", "a_n", "b_n").agg(F.count("*").alias("grams")), "pairs")
    # each document against the one first holder that it meets most often; only what this leaves apart meets its other first holders
    likely = pairs.groupBy("b").agg(F.max(F.struct("grams", -F.col("a"), "a_n", "b_n")).alias("m"))
    likely = space.table(likely.select((-F.col("m.col2")).alias("a"), "b", "m.a_n", "m.b_n"), "likely")
    links = tested_links(rows, firsts, likely, flags, words, percent, cells)
    found = components(links)
    part = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_part"))
    apart = pairs.join(likely.select("a", "b"), ["a", "b"], "left_anti").join(part("a"), "a", "left").join(part("b"), "b", "left")
    apart = space.table(apart.filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b", "a_n", "b_n"), "apart")
    if not apart.isEmpty():
        links = space.table(links.union(tested_links(rows, firsts, apart, flags, words, percent, cells)), "links")
        found = components(links)
    placed = space.table(buckets.join(found, buckets["rep"] == found["node"], "left").select("gram", "rep", "n", "at", F.coalesce("component", "rep").alias("component")), "placed")
    # where an n-gram's documents are in several components: those outside its largest one, against all others
    sizes = placed.groupBy("gram", "component").count()
    mixed = sizes.groupBy("gram").agg(F.count("*").alias("parts"), F.max(F.struct("count", "component"))["component"].alias("main")).filter("parts > 1")
    open_rows = space.table(placed.join(mixed, "gram"), "open")
    tested = likely.select("a", "b").union(apart.select("a", "b"))
    space.keep(sets, classes, copies, likely, apart, links, open_rows)
    a = open_rows.filter("component <> main").select("gram", F.col("rep").alias("x"), F.col("n").alias("a_n"), F.col("at").alias("a_at"), F.col("component").alias("x_part"))
    b = open_rows.select("gram", F.col("rep").alias("y"), F.col("n").alias("b_n"), F.col("at").alias("b_at"), F.col("component").alias("y_part"))
    rest = a.join(b, "gram").filter(f"x_part <> y_part and {near}")  # one condition of the join: what fails it is never a row
    rest = rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"), F.when(F.col("x") < F.col("y"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"))
    rest = space.table(rest.distinct().join(tested, ["a", "b"], "left_anti"), "rest")
    all_links = links if rest.isEmpty() else space.table(links.union(tested_links(rows, firsts, rest, flags, words, percent, cells)), "links")
    final = found if rest.isEmpty() else components(all_links)

    ends = all_links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").count()
    by_class = classes.select("set_key", "rep").join(final, F.col("rep") == F.col("node"), "left").join(ends, "rep", "left")
    by_class = by_class.select("set_key", F.coalesce("component", "rep").alias("component"), F.coalesce("count", F.lit(0)).alias("n_links"))
    members = sets.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(by_class, "set_key", "left")
    out = space.table(members.select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    ), "members")
    space.keep(out)
    return out


def possible_pairs(firsts: DataFrame, pairs: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """Those ``pairs`` whose prefixes share enough: the set whose prefix ends first adds at most its other n-grams to that."""
    left = firsts.select(F.col("rep").alias("a"), F.col("prefix").alias("a_prefix"))
    right = firsts.select(F.col("rep").alias("b"), F.col("prefix").alias("b_prefix"))
    shared = F.size(F.array_intersect("a_prefix", "b_prefix"))
    rest = F.greatest(F.col("a_n") - F.size("a_prefix"), F.col("b_n") - F.size("b_prefix"))
    most = shared + rest
    enough = (100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))
    return space.table(pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b", "a_n", "b_n").distinct(), "possible")


def tested_links(rows: DataFrame, firsts: DataFrame, pairs: DataFrame, flags, words: int, percent: int, cells: int) -> DataFrame:
    """(a, b) of stored ``pairs`` (a, b, a_n, b_n) that link: overlaps counted per fragment and summed. Stored."""
    space = Workspace(rows.sparkSession)
    pairs = possible_pairs(firsts, pairs, percent, space)
    roles = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(True).alias("is_a")), F.struct(F.col("b").alias("id"), F.lit(False).alias("is_a")))).alias("r"))
    ids = space.table(roles.groupBy(F.col("r.id").alias("wanted")).agg(F.bool_or("r.is_a").alias("is_a"), F.bool_or(~F.col("r.is_a")).alias("is_b")), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    wanted = rows.join(side, F.col("doc_id") == F.col("wanted")).select("doc_id", "text", "is_a", "is_b")

    def cut(ids_, texts, as_a, as_b):
        for doc, text, is_a, is_b in zip(ids_, texts, as_a, as_b, strict=True):
            ordered, rare = in_order(shingles(text, words), flags.value, cells)
            for half, grams in enumerate((ordered[:rare], ordered[rare:])):
                # both halves are sorted by hash: fragments are ranges of it
                edges = np.searchsorted(grams, [np.uint64((i * 2**64) // FRAGMENTS) for i in range(1, FRAGMENTS)])
                for i, part in enumerate(np.split(grams, edges)):
                    if len(part):
                        yield doc, half * FRAGMENTS + i, part.tobytes(), is_a, is_b

    fragments = space.table(arrow_pass(wanted, cut, "doc_id long, fragment int, grams binary, is_a boolean, is_b boolean"), "fragments")
    left = fragments.filter("is_a").select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("a_grams"))
    right = fragments.filter("is_b").select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("b_grams"))
    joined = pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])

    def overlap(a, b, fragment, a_grams, b_grams):
        for x, y, f, u, v in zip(a, b, fragment, a_grams, b_grams, strict=True):
            yield x, y, f, len(np.intersect1d(np.frombuffer(u, np.uint64), np.frombuffer(v, np.uint64), assume_unique=True))

    partial = arrow_pass(joined.select("a", "b", "fragment", "a_grams", "b_grams"), overlap, "a long, b long, fragment int, overlap long")
    # a repeated row gives the same overlap again: one per pair and fragment counts
    sums = partial.groupBy("a", "b", "fragment").agg(F.max("overlap").alias("overlap")).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    links = space.table(pairs.join(sums, ["a", "b"]).filter(f"100 * overlap >= {percent} * (a_n + b_n - overlap)").select("a", "b"), "links")
    space.keep(links)
    return links


#: Names of rows whose id names no single text start here, behind all ids.
_NAMELESS = 1 << 62


def _named(docs: DataFrame, id_col: str, text_col: str, space: Workspace) -> DataFrame:
    """(name, id, text, row): the id, or a hash of id and text where the id is null or stands for differing texts."""
    identity, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    versions = docs.select(identity.alias("id"), F.xxhash64(text).alias("version")).filter("id is not null").groupBy("id")
    twofold = space.table(versions.agg(F.min("version").alias("low"), F.max("version").alias("high")).filter("low <> high").select("id", F.lit(True).alias("twofold")), "twofold")
    rows = docs.select(identity.alias("id"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(twofold, "id", "left")
    own = F.lit(_NAMELESS) + F.pmod(F.xxhash64("id", "text"), F.lit(_NAMELESS))
    return rows.select(F.when(F.col("id").isNull() | F.col("twofold").isNotNull(), own).otherwise(F.col("id")).alias("name"), "id", "text", "row")


def without_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of linked documents, with all its columns: that of the smallest id, null ids last.

    Rows with a null id and differing texts under one id are judged by their own text. Of rows that repeat both id and text
    one stays. Documents without words are linked with nothing and stay.
    """
    space = Workspace(docs.sparkSession)
    rows = _named(docs, id_col, text_col, space)
    linked = linked_documents(rows.select("name", "text"), words=words, percent=percent, id_col="name")
    linked = space.table(linked.select("name", "component_id").join(rows.select("name", "id").distinct(), "name"), "linked")
    stays = linked.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "name")).alias("stays"))
    later = linked.join(stays, "component_id").filter("name <> stays.name").select("name").distinct()
    again = linked.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    odd = space.table(later.select("name", F.lit(False).alias("repeats")).union(again.join(later, "name", "left_anti").select("name", F.lit(True))), "odd")
    alone = rows.join(odd, "name", "left_anti").select("row")
    repeated = rows.join(odd.filter("repeats"), "name", "left_semi").groupBy("name").agg(F.min("row").alias("row")).select("row")
    return alone.union(repeated).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE_SQL = {
    "op2_jaccard_join": """
        with recursive w as (
            select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] as ws
            from documents
        ),
        s as (
            select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
                   else [array_to_string(ws[i:i+3], ' ') for i in range(1, len(ws) - 2)] end) as grams
            from w
        ),
        g as (select doc_id, unnest(grams) as gram from s),
        o as (select a.doc_id as x, b.doc_id as y, count(*) as n from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
        l as (
            select o.x, o.y from o join s sx on sx.doc_id = o.x join s sy on sy.doc_id = o.y
            where 100 * o.n >= 85 * (len(sx.grams) + len(sy.grams) - o.n)
        ),
        r as (select doc_id as x, doc_id as y from s union select r.x, l.y from r join l on l.x = r.y)
        select s.doc_id, len(s.grams) as n_shingles, min(r.y) as component_id from s join r on r.x = s.doc_id group by 1, 2
    """,
}
