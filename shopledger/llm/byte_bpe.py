"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenation.

A text of at most ``CHUNK`` characters is one chunk. A longer one is cut into chunks that overlap by ``OVERLAP`` characters;
the chunks are rows of their own, dealt over the cluster and pre-tokenised side by side. A match of the pattern depends only
on where it starts and on the text behind it, so as soon as two neighbours have a boundary in common inside their overlap,
all later boundaries agree: the chunks are stitched there. Where an overlap holds no common boundary (one endless run) the
neighbours become one piece. The pieces between stitches are dealt out again, encoded, and joined by document and order.

Inside a piece, text is cut before spaces (see ``common.cut_at_spaces``), and what a worker has encoded before is reused.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PieceCache, arrow_pass, cut_at_spaces, encode_pieces, load_encoding, load_ranks, read_table, tokenizer_path

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 65_536
OVERLAP = 512
#: A boundary this near a chunk's end may depend on text that the chunk does not hold (a contraction has three characters).
_GUARD = 4


@lru_cache(maxsize=2)
def _cache(path: str) -> PieceCache:
    encoding = load_encoding(path)
    return PieceCache(lambda pieces: encode_pieces(encoding, pieces))


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def encode_text(text: str, path: str) -> bytes:
    """The ids of ``text`` as little-endian unsigned 32-bit integers."""
    pieces = cut_at_spaces(text)
    if pieces is None:
        return np.array(load_encoding(path).encode_ordinary(text), "<u4").tobytes()
    known = _cache(path)
    known.learn(set(pieces))
    return b"".join(map(known.__getitem__, pieces))


def decode_ids(ids: bytes, path: str) -> bytes:
    """The bytes that packed ids stand for."""
    table = _token_bytes(path)
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=1)
def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str, upto: int, closed: bool) -> list[int]:
    """Starts of pre-tokens of ``text`` below ``upto`` that hold whatever follows; ``closed``: nothing follows the text."""
    trusted = len(text) if closed else len(text) - _GUARD
    starts = []
    for match in _pattern().finditer(text):
        start = match.start()
        if start >= upto or start > trusted:
            break
        starts.append(start)
        if match.end() >= len(text) and not closed:  # the match may go on behind the chunk
            break
    return starts


def stitched_pieces(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, piece, part): texts cut where neighbouring chunks resynchronise. ``long_docs``: (key, text)."""
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / chunk) - 1).cast("int")
    chunks = long_docs.select("key", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk"), last.alias("last")).select(
        "key",
        "chunk",
        F.when(F.col("chunk") == F.col("last"), F.expr(f"substring(text, chunk * {chunk} + 1)"))
        .otherwise(F.expr(f"substring(text, chunk * {chunk} + 1, {chunk + overlap})"))
        .alias("text"),
        (F.col("chunk") == F.col("last")).alias("closed"),
    )

    def split(keys, numbers, texts, closed):
        for key, number, text, end in zip(keys, numbers, texts, closed, strict=True):
            base = number * chunk
            starts = boundaries(text, len(text), end)
            lead = [base + s for s in starts if s < overlap]
            trail = [base + s for s in starts if chunk <= s < chunk + overlap]
            yield key, number, lead, trail

    bounds = arrow_pass(chunks.repartition("key", "chunk"), split, "key string, chunk int, lead array<int>, trail array<int>")
    before = bounds.select("key", (F.col("chunk") + 1).alias("chunk"), "trail")
    # the first boundary that a chunk shares with the one before it; none: the two stay one piece
    cuts = (
        bounds.select("key", "chunk", "lead")
        .join(before, ["key", "chunk"])
        .select("key", F.array_min(F.array_intersect("lead", "trail")).alias("cut"))
        .groupBy("key")
        .agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    )
    edges = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.length("text")))
    return (
        long_docs.join(cuts, "key", "left")
        .withColumn("edges", edges)
        .select("key", "text", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("piece"))
        .select("key", "piece", F.expr("substring(text, edges[piece - 1] + 1, edges[piece] - edges[piece - 1])").alias("part"))
        .repartition("key", "piece")
    )


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) per row, ids as packed little-endian unsigned 32-bit integers; null texts are empty.

    ``digest``: instead of ids, ids_sha256 (of decimal ids joined by commas) and decoded_sha256, made in the same pass, so that
    no ids are stored. Null and repeated ids are kept, row by row; a long row is known by a random key while it is cut.
    Columns other than the two named are not read. Only texts above ``chunk`` characters are shuffled.
    """
    path = ranks or tokenizer_path(RANKS)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long: Column = F.length("text") > chunk

    def outcome(doc, ids: bytes) -> tuple:
        if not digest:
            return doc, len(ids) // 4, ids
        decimal = ",".join(map(str, np.frombuffer(ids, "<u4").tolist()))
        return doc, len(ids) // 4, hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decode_ids(ids, path)).hexdigest()

    results = "ids_sha256 string, decoded_sha256 string" if digest else "ids binary"
    schema = f"id {kind}, n_tokens long, {results}"

    def short(docs_, texts):
        for doc, text in zip(docs_, texts, strict=True):
            yield outcome(doc, encode_text(text, path))

    def pieces(keys, numbers, parts):
        for key, number, part in zip(keys, numbers, parts, strict=True):
            yield key, number, encode_text(part, path)

    def finish(docs_, parts):
        for doc, ids in zip(docs_, parts, strict=True):
            yield outcome(doc, b"".join(p["ids"] for p in ids))

    # a row's key follows from its content; equal rows share it, and are told apart by their count
    long_docs = rows.filter(is_long).withColumn("key", F.concat_ws("-", F.sha2("text", 256), F.length("text")))
    by_text = long_docs.groupBy("key").agg(F.first("text").alias("text"))
    encoded = arrow_pass(stitched_pieces(by_text, chunk, overlap), pieces, "key string, piece int, ids binary")
    whole = encoded.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    long_rows = arrow_pass(long_docs.select("id", "key").join(whole, "key").select("id", "parts"), finish, schema)
    out = arrow_pass(rows.filter(~is_long), short, schema).unionByName(long_rows)
    return out.withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", ranks: str | None = None) -> DataFrame:
    """(doc_id, bytes) from packed ids; null ids give no bytes."""
    path = ranks or tokenizer_path(RANKS)
    kind = encoded.schema[id_col].dataType.simpleString()

    def work(docs, packed):
        for doc, ids in zip(docs, packed, strict=True):
            yield doc, decode_ids(ids or b"", path)

    return arrow_pass(encoded.select(id_col, ids_col), work, f"`{id_col}` {kind}, bytes binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), digest=True)


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
