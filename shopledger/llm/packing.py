"""Best-fit packing planned on the histogram of lengths.

1. One pass tokenises the documents and gives a row per piece (length, checksum, and the ids if asked for).
2. Pieces are counted per length: at most ``capacity`` rows, whatever the corpus.
3. Best fit decreasing runs on the counts: a group of equal bins takes a piece length at once. The plan is a list of runs
   (length, first rank, count, first sequence, offset), again bounded by the capacity alone.
4. Every piece gets its rank within its length and takes the slot of the run that holds the rank. Ranks are numbered inside
   (length, salt) and shifted by the counts of the salts before; a length gets salts by its count and share, so that one
   that most pieces have is no hot key at any size.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import through_table
from .common import arrow_pass, load_encoding, load_tokenizer, ranks_give_merges, read_table, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for the faster library; used after a proof that both encode every text alike.
RANKS = "byte_bpe_50k.tiktoken"
CAPACITY = 1024
END_ID = 2
#: A length is dealt to a salt per so many of its pieces, about, and per so large a share of all pieces: 1 / SALTS.
SALT_PIECES, SALTS = 500_000, 64


def encode_text(text: str, path: str, ranks: str | None = None) -> bytes:
    """The library's ids without added tokens, packed; a special string inside the text is its default, one id.

    ``ranks`` is the rank form of the same vocabulary, given where it is proven to encode alike.
    """
    if ranks and "<|" not in text:
        return np.array(load_encoding(ranks).encode_ordinary(text), "<u4").tobytes()
    return np.array(load_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def token_pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): whole documents, or pieces of ``capacity`` of longer ones, remainder first."""
    kind = docs.schema[id_col].dataType.simpleString()
    ranks = tokenizer_path(RANKS)
    if vocabulary != tokenizer_path(VOCABULARY) or not ranks_give_merges(vocabulary, ranks):
        ranks = None
    end = np.array([end_id], "<u4").tobytes()

    def work(ids_, texts):
        for doc, text in zip(ids_, texts, strict=True):
            packed = encode_text(text or "", vocabulary, ranks) + end
            n = len(packed) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                part = packed[4 * a : 4 * b]
                yield (doc, piece, a, b - a, zlib.crc32(part), *((part,) if with_ids else ()))

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_pass(docs.select(id_col, text_col), work, schema)


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that put every counted piece into a bin of ``capacity``.

    Best fit decreasing on counts: bins with the same room left form groups of consecutive numbers; the longest pieces go
    first, each into the fullest group they fit. One step serves a whole group or a whole length.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, bins)
    plan, sequences = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:  # so many new bins that each is filled with this length before the next is opened
                room, bins = capacity, -(-left // (capacity // length))
                first, sequences = sequences, sequences + bins
            else:
                first, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            taken = min(left, bins)
            if taken < bins:
                rooms.setdefault(room, []).append((first + taken, bins - taken))
            plan.append((length, rank, taken, first, capacity - room))
            if room > length:
                rooms.setdefault(room - length, []).append((first, taken))
            rank, left = rank + taken, left - taken
    return plan


def assign_slots(pieces: DataFrame, capacity: int, salt_pieces: int = SALT_PIECES) -> DataFrame:
    """``pieces`` (id, piece, length, ...) with sequence_id and offset. ``pieces`` is read three times: pass a stored table."""
    spark = pieces.sparkSession
    found = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    total = sum(found.values())
    table = [(length, max(-(-n // salt_pieces), -(-n * SALTS // total))) for length, n in found.items()]
    salts = F.broadcast(spark.createDataFrame(table, "length long, salts long"))
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), "salts").cast("int")).drop("salts")
    cells = salted.groupBy("length", "salt").count()
    cells = cells.collect()  # capacity + SALTS rows at most, and one per salt_pieces pieces
    shifts, counts = [], {}
    for length, salt, n in sorted((c["length"], c["salt"], c["count"]) for c in cells):
        shifts.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    plan = plan_best_fit(counts, capacity)
    by_length: dict[int, list] = {}
    for length, rank, n, first, offset in plan:
        by_length.setdefault(length, []).append((rank, rank + n, first, offset))
    # one row per (length, salt) with only those runs that its ranks can reach
    table = []
    size = {(c["length"], c["salt"]): c["count"] for c in cells}
    for length, salt, shift in shifts:
        low, high = shift, shift + size[length, salt]
        table.append((length, salt, shift, [r for r in by_length[length] if r[0] < high and r[1] > low]))
    schema = "length long, salt int, shift long, runs array<struct<low:long,high:long,first:long,offset:long>>"
    slots = spark.createDataFrame(table, schema)  # as many rows as cells: the planner broadcasts it while it is small
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")))
    placed = ranked.join(slots, ["length", "salt"]).withColumn("rank", F.col("shift") + F.col("rank") - 1)
    run = F.filter("runs", lambda r: (r["low"] <= F.col("rank")) & (F.col("rank") < r["high"]))[0]
    return placed.withColumn("run", run).select(
        *pieces.columns, (F.col("run.first") + F.col("rank") - F.col("run.low")).alias("sequence_id"), F.col("run.offset").alias("offset")
    )


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every token of every row, in as few sequences as best fit finds.

    A null text is empty and packs as its end id alone. Null ids and repeated rows are packed like any others. Other columns
    are not read. An empty table gives no rows. ``with_ids`` adds the packed ids of each piece.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)
    pieces = through_table(token_pieces(docs, id_col, text_col, path, capacity, end_id, with_ids), "pieces")
    return assign_slots(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): training sequences from the rows of ``pack_documents(with_ids=True)``; a group is one sequence."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def work(numbers, parts_):
        for number, found in zip(numbers, parts_, strict=True):
            yield number, np.frombuffer(b"".join(p["ids"] for p in found), "<u4").tolist()

    return arrow_pass(parts, work, "sequence_id long, ids array<long>")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
