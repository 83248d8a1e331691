"""Quality rules: plain counts, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Importance scoring: byte n-grams are hashed into ``BUCKETS`` cells. One pass counts every document of the corpus (raw) and, of
these, the trusted ones (target). With add-one smoothing both give a multinomial; a document's score is the mean of
``log target(cell) - log raw(cell)`` over its n-grams, that is, length-normalised. The threshold is fixed, so the verdict on a
document does not depend on chance or on its neighbours. What is gathered per cell is summed over all documents; only the two
arrays of ``BUCKETS`` numbers reach the driver and go back to the workers, whatever the corpus.

Trusted ids come from labels: at most ``MAX_TRUSTED``, those with the smallest hash, so that the table of ids that is
broadcast has a bound. This bound is the only sample here; counts and scores cover every document and every byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SPACE, arrow_pass, read_table, ship_package, words_of

BUCKETS = 1 << 16
GRAM = 4
MAX_TRUSTED = 50_000
#: Mean log ratio per n-gram below which a document is rejected. Held-out clean documents score -0.67 and more on 1,000
#: documents (a language that the target hardly has) and -0.12 and more on 4,000; symbol and shouting junk has a median near -1.7.
THRESHOLD = -0.7
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Bytes hashed at once.
_BLOCK = 1 << 20


def gram_cells(text: str) -> Iterator[np.ndarray]:
    """The cells of the text's byte n-grams, block by block; shorter texts have none."""
    data = np.frombuffer(text.encode(), np.uint8)
    for at in range(0, max(0, len(data) - GRAM + 1), _BLOCK):
        block = data[at : at + _BLOCK + GRAM - 1].astype(np.uint32)
        grams = np.zeros(len(block) - GRAM + 1, np.uint32)
        for i in range(GRAM):
            grams = (grams << np.uint32(8)) | block[i : len(grams) + i]
        yield ((grams * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % BUCKETS


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int = MAX_TRUSTED) -> DataFrame:
    """Ids of good and not toxic labelled documents: all, or the ``most`` with the smallest hash. Null labels trust nothing."""
    good = labels.filter((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False)) & F.col(id_col).isNotNull())
    return good.select(F.col(id_col).alias("trusted_id")).distinct().orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def gram_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log target - log raw per cell, from all ``docs``. Without any trusted document every ratio is 0."""
    ship_package(docs.sparkSession)
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(trusted), F.col("id") == F.col("trusted_id"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for cells in gram_cells(text or ""):
                    counts = np.bincount(cells, minlength=BUCKETS) if len(cells) > BUCKETS // 4 else None
                    if counts is None:
                        np.add.at(raw, cells, 1)
                        if good:
                            np.add.at(target, cells, 1)
                    else:
                        raw += counts
                        target += counts if good else 0
        full = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(raw[full]), pa.array(target[full])], ["cell", "raw", "target"])

    counted = marked.select("text", F.col("trusted_id").isNotNull().alias("good")).mapInArrow(count, "cell int, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for cell, r, t in counted.groupBy("cell").agg(F.sum("raw"), F.sum("target")).collect():  # BUCKETS rows at most
        raw[cell], target[cell] = r, t
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` (a power of two) words that the text holds twice or more, the first included.

    Windows are named by doubling: equal pairs of equal halves get one number, so no hash can collide.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    names = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    step = 1
    while step < window:
        pairs = names[:-step] * (len(words) + 1) + names[step:]
        _, names = np.unique(pairs, return_inverse=True)
        step *= 2
    again = np.bincount(names)[names] > 1
    if not again.any():
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.flatnonzero(again), 1)
    np.add.at(change, np.flatnonzero(again) + window, -1)
    return int((np.cumsum(change) > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = text.split("\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[str] = set()
    found = 0
    for line in lines:
        if line.strip(WORD_SPACE):
            found += line in seen
            seen.add(line)
    return found


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(text: str | None, ratios: np.ndarray, threshold: float) -> tuple:
    """The columns of ``_COUNTS`` for one text."""
    text = text or ""
    words = words_of(text)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    total = grams = 0
    for cells in gram_cells(text):
        total, grams = total + float(ratios[cells].sum()), grams + len(cells)
    score = total / grams if grams else 0.0
    chars = len(text) - sum(map(text.count, WORD_SPACE))
    return len(words), chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat, failed, score, not failed and score >= threshold


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) per row of ``docs``.

    A null or empty text has no words, so it fails the base rules. A text without n-grams scores 0. Null ids are never
    trusted, but scored like others; repeated rows count as often as they occur. Other columns are not read.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(gram_ratios(docs, trusted_ids(labels), id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def work(ids, texts):
        for doc, text in zip(ids, texts, strict=True):
            yield doc, *judge(text, ratios.value, threshold)

    return arrow_pass(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, {_COUNTS}")


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` keeps, with all columns as they are.

    Each row is judged by its own text where it lies, so nothing is joined back: rows with a null id and rows that repeat an
    id stay or go like any other.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(gram_ratios(docs, trusted_ids(labels), id_col, text_col))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(text, ratios.value, threshold)[-1] for text in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE_SQL: dict[str, str] = {}
