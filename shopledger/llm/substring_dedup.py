"""Substring dedup: an FM-index per shard finds word windows that also start earlier.

Routing. A full index of the corpus would have to be searched shard by shard for each document. Instead every window of
``WINDOW`` words goes to the shard of its minimizer: the smallest hash among its ``GRAM``-word grams. Equal windows have equal
minimizers, so they meet. Neighbouring windows mostly share a minimizer and travel as one segment.

1. One pass names each segment by its minimizer and a content key. Per content the first occurrence is kept by a map-side-
   reduced aggregate; every later occurrence repeats earlier text from its first word to its last.
2. Minimizers with a single content are done. The words of the first occurrences of the others are fetched and dealt to shards
   by minimizer; each shard builds an FM-index (Burrows-Wheeler transform in a wavelet matrix) over its segments and streams
   their windows through backward search: a window whose matching statistic reaches ``WINDOW`` has an interval of suffixes,
   and it is reported if the first of these in corpus order starts before it.
3. A minimizer with more than ``HOT`` contents would make a shard too large; its windows are compared as windows: keys per
   window, first occurrence by aggregate. The result is the same.

Reported windows and later occurrences give intervals per document; the words they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_pass, read_table, replace_column, ship_package, words_of
from .fm_index import FMIndex
from .jaccard_join import hash_windows, hash_words

WINDOW = 20
GRAM = 6
#: Segments of about so many words make a shard.
SHARD_SEGMENTS = 30_000
#: Contents per minimizer above which its windows are compared one by one.
HOT = 20_000
#: Rows up to this number may travel to every task; more are joined by a shuffle.
BROADCAST_ROWS = 300_000

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 2**64)) for b in _ODD)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)


def content_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of the word sequences [start, end): polynomials of the word hashes, alike wherever the sequence stands."""
    keys = []
    for base, inverse, turn in zip(_ODD, _INVERSE, (0, 17), strict=True):
        turned = hashes if not turn else (hashes << np.uint64(turn)) ^ (hashes >> np.uint64(64 - turn))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(turned * _powers(base, len(hashes))[:-1], dtype=np.uint64)])
        value = (sums[ends] - sums[starts]) * _powers(inverse, len(hashes))[starts]
        value ^= value >> np.uint64(32)
        keys.append(((value + (ends - starts).astype(np.uint64)) * _ODD[1]).view(np.int64))
    return keys[0], (keys[1] >> 32).astype(np.int32)


def segments_of(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimizer) of the runs of windows that share a minimizer."""
    grams = hash_windows(hashes, gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    at = np.concatenate([np.arange(a, min(a + 65536, len(views))) + views[a : a + 65536].argmin(axis=1) for a in range(0, len(views), 65536)])
    starts = np.concatenate([[0], 1 + np.flatnonzero(at[1:] != at[:-1])])
    return starts, np.diff(np.concatenate([starts, [len(at)]])), grams[at[starts]].view(np.int64)


def segment_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(minimizer, k1, k2, doc_id, pos, run): the segments of all documents (doc_id, text) with a window."""
    ship_package(docs.sparkSession)
    names = ["minimizer", "k1", "k2", "doc_id", "pos", "run"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            rows = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if doc is None or len(words) < window:
                    continue
                hashes = hash_words(words)
                starts, runs, minimizers = segments_of(hashes, window, gram)
                k1, k2 = content_keys(hashes, starts, starts + runs + window - 1)
                found.append((minimizers, k1, k2, np.full(len(starts), doc, np.int64), starts.astype(np.int32), runs.astype(np.int32)))
                rows += len(starts)
                if rows > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)
                    found, rows = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(work, "minimizer long, k1 long, k2 int, doc_id long, pos int, run int")


def earlier_windows(segments: DataFrame, window: int, shards: int) -> DataFrame:
    """(doc_id, start, end): word intervals of ``segments`` (minimizer, doc_id, pos, words) whose windows also start earlier
    in another segment of their minimizer. Each of the ``shards`` partitions builds its index and streams its segments."""
    ship_package(segments.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        parts, docs, places = [], [], []
        for batch in batches:
            for doc, pos, words in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words.encode().split()] + [0], np.int64))
                docs.append(doc)
                places.append(pos)
        if len(parts) < 2:
            return
        lengths = np.array([len(p) for p in parts])
        symbols = np.concatenate(parts)
        base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        # where each symbol stands in the corpus, as a number that orders (document, word)
        doc, pos = np.repeat(np.array(docs, np.int64), lengths), np.arange(len(symbols)) + np.repeat(np.array(places, np.int64) - base, lengths)
        corpus = np.empty(len(symbols), np.int64)
        corpus[np.lexsort((pos, doc))] = np.arange(len(symbols))
        counts = np.maximum(lengths - window, 0)
        starts = np.arange(counts.sum()) + np.repeat(base - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        index = FMIndex(symbols, window)
        low, high = index.repeated(symbols, starts, window)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return
        # equal windows have one interval, different ones are apart: the first occurrence of each by one reduction
        spans, which = np.unique(np.stack([low[hit], high[hit]], 1), axis=0, return_inverse=True)
        firsts = np.minimum.reduceat(np.append(corpus[index.order], len(symbols)), spans.ravel())[::2]
        same = (doc, pos)
        at = starts[hit]
        first_at = np.empty(len(symbols), np.int64)
        first_at[corpus] = np.arange(len(symbols))
        source = first_at[firsts[which.ravel()]]
        earlier = (same[0][source] < same[0][at]) | ((same[0][source] == same[0][at]) & (same[1][source] < same[1][at]))
        at = np.sort(at[earlier])
        if not len(at):
            return
        heads = np.concatenate([[0], 1 + np.flatnonzero(np.diff(at) != 1)])
        tails = np.concatenate([heads[1:], [len(at)]]) - 1
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc[at[heads]]), "start": pa.array(pos[at[heads]].astype(np.int32)), "end": pa.array((pos[at[tails]] + window).astype(np.int32))})

    dealt = segments.select("minimizer", "doc_id", "pos", "words").repartition(shards, "minimizer")
    return dealt.mapInArrow(work, "doc_id long, start int, end int")


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_segments: int = SHARD_SEGMENTS) -> DataFrame:
    """(doc_id, intervals): for ``docs`` (doc_id, text), the word intervals covered by windows that also start earlier."""
    space = Workspace(docs.sparkSession)
    found = segment_table(docs, window, gram)
    contents = space.table(
        found.groupBy("k1", "k2", "minimizer").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"), F.first("run").alias("run")).groupBy("minimizer").agg(
            F.count("*").alias("contents"), F.max("n").alias("most")
        ).filter("contents > 1 or most > 1"),
        "minimizers",
    )
    # only segments of minimizers that occur twice go on
    side = F.broadcast(contents) if contents.count() <= BROADCAST_ROWS else contents
    kept = space.table(found.join(side.select("minimizer", "contents"), "minimizer"), "segments")
    space.keep(kept)  # the minimizers are part of it
    firsts = space.table(kept.groupBy("k1", "k2", "minimizer", "contents").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n"), F.first("run").alias("run")), "firsts")
    later = kept.join(firsts.filter("n > 1").select("k1", "k2", "first"), ["k1", "k2"]).filter(F.struct("doc_id", "pos") > F.col("first"))
    later = space.table(later.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + F.col("run") + window - 1).alias("end")), "later")

    several = space.table(firsts.filter("contents > 1").select("minimizer", "contents", "first.doc_id", "first.pos", "run"), "several")
    space.keep(later, several)
    per_doc = several.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "run", "minimizer", "contents")).alias("wanted"))
    ids = several.select("doc_id").distinct()
    texts = docs.select("doc_id", "text")
    if several.count() > 0 and ids.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")

    def cut(docs_, texts_, wanted_):
        for doc, text, wanted in zip(docs_, texts_, wanted_, strict=True):
            words = words_of(text)
            for w in wanted:
                end = w["pos"] + w["run"] + window - 1
                yield w["minimizer"], w["contents"], doc, w["pos"], b" ".join(words[w["pos"] : end]).decode("utf-8", "surrogatepass")

    cuts = space.table(arrow_pass(texts.join(per_doc, "doc_id").select("doc_id", "text", "wanted"), cut, "minimizer long, contents long, doc_id long, pos int, words string").dropDuplicates(["minimizer", "doc_id", "pos"]), "cuts")
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-several.count() // shard_segments))
    space.keep(later, cuts)
    reported = earlier_windows(cuts.filter(F.col("contents") <= hot), window, shards)

    def single(docs_, places, texts_):
        for doc, pos, text in zip(docs_, places, texts_, strict=True):
            words = text.encode().split()
            for i in range(len(words) - window + 1):
                yield doc, pos + i, hashlib.md5(b" ".join(words[i : i + window])).digest()

    windows = arrow_pass(cuts.filter(F.col("contents") > hot).select("doc_id", "pos", "words"), single, "doc_id long, pos int, key binary")
    first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    hot_hits = windows.join(first, "key").filter(F.struct("doc_id", "pos") > F.col("first")).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + window).alias("end"))
    every = later.unionByName(reported).unionByName(hot_hits)
    intervals = space.table(every.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("intervals")), "intervals")
    space.keep(intervals)
    return intervals


def kept_words(words: list[bytes], intervals) -> list[bytes]:
    if not intervals:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, [i["start"] for i in intervals], 1)
    np.add.at(change, [i["end"] for i in intervals], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _with_intervals(docs: DataFrame, window: int) -> DataFrame:
    pairs = docs.select("doc_id", "text")
    return pairs.join(repeated_intervals(pairs, window), "doc_id", "left")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the words that lie in a window of ``window`` words which also starts earlier.

    Earlier: in a smaller id, or further up in the same document; windows are judged on the input. A text that loses words is
    its kept words joined by single spaces; others stay byte for byte. Null, empty and shorter texts and rows with a null id
    lose nothing. Rows that repeat an id are one document. All columns stay, whatever they are called.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    hit = pairs.join(repeated_intervals(pairs, window), "doc_id")

    def rewrite(ids, texts, intervals):
        for doc, text, found in zip(ids, texts, intervals, strict=True):
            yield doc, b" ".join(kept_words(words_of(text), found)).decode("utf-8", "surrogatepass")

    new = arrow_pass(hit, rewrite, "doc_id long, kept string").dropDuplicates(["doc_id"])
    return replace_column(docs, id_col, text_col, new.withColumnRenamed("doc_id", id_col), "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _with_intervals(read_table(spark, sf_dir, "documents"), WINDOW)

    def digest(ids, texts, intervals):
        for doc, text, hits in zip(ids, texts, intervals, strict=True):
            words = words_of(text)
            kept = kept_words(words, hits)
            yield doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return arrow_pass(found.select("doc_id", "text", "intervals"), digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE_SQL = {
    "op8_substring_dedup": """
        with w as (
            select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> ''] as ws from documents
        ),
        k as (select doc_id, unnest([md5(array_to_string(ws[i:i+19], ' ')) for i in range(1, greatest(len(ws) - 18, 1))]) as key, unnest(range(1, greatest(len(ws) - 18, 1))) as pos from w),
        later as (select doc_id, pos from (select *, row_number() over (partition by key order by doc_id, pos) as n from k) where n > 1),
        gone as (select distinct doc_id, pos + o as pos from later, range(20) t(o)),
        words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
        kept as (
            select x.doc_id, count(g.pos) as n_removed, coalesce(string_agg(x.word, ' ' order by x.pos) filter (where g.pos is null), '') as text
            from words x left join gone g on g.doc_id = x.doc_id and g.pos = x.pos group by x.doc_id
        )
        select w.doc_id, len(w.ws) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
        from w left join kept on kept.doc_id = w.doc_id
    """,
}
