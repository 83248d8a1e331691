"""Token counts: words that are one token by proof are counted from a table; only the rest is merged.

Offline proof. The vocabulary is a BPE with word ends: an entry ``x</w>`` is the form of a whole pre-token. For each such entry
the tokenizer encodes ``x`` alone; if that gives one id, every pre-token ``x`` counts one and needs no merge. The proof runs
once per worker over the vocabulary (not over data).

Words. This tokenizer drops white space, so a text is the sum of its ASCII-space-separated words. A word of lower-case ASCII
letters is one pre-token and is looked up at once. Any other ASCII word is cut into pre-tokens, each looked up; what the table
does not hold, and words with other characters or special strings, go through the library. Results are cached per worker.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PieceCache, arrow_pass, load_tokenizer, read_table, tokenizer_path, words_of

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: The pre-token pattern of the tokenizer file on lower-case ASCII; a fixed value.
_ASCII_PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


@lru_cache(maxsize=2)
def proven_single_tokens(path: str) -> frozenset[str]:
    """ASCII vocabulary strings that encode alone as exactly their one token, checked with the library itself."""
    tokenizer = load_tokenizer(path)
    end = "</w>"
    strings = [v[: -len(end)] for v in tokenizer.get_vocab(with_added_tokens=False) if v.endswith(end) and len(v) > len(end)]
    strings = [s for s in strings if s.isascii()]
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found, strict=True) if e.ids == [vocabulary[s + end]])


def word_counter(path: str) -> PieceCache:
    """Token counts by word (bytes), filled on demand."""
    tokenizer, single = load_tokenizer(path), proven_single_tokens(path)

    def merge(strings: list[str]) -> list[int]:
        return [len(e.ids) for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def count(words: list[bytes]) -> list[int]:
        counts, rest = [0] * len(words), []  # rest: (word's place, string to merge)
        for i, raw in enumerate(words):
            word = raw.decode("utf-8", "surrogatepass")
            if not word.isascii() or "<|" in word:
                rest.append((i, word))
                continue
            for part in _ASCII_PRE_TOKENS.findall(word.lower()):
                if part in single:
                    counts[i] += 1
                else:
                    rest.append((i, part))
        for (i, _), n in zip(rest, merge([s for _, s in rest]), strict=True):
            counts[i] += n
        return counts

    return PieceCache(count)


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCache:
    return word_counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``, in one pass without a shuffle.

    A null or empty text has 0 bytes and 0 tokens. Null and repeated ids stay as they are, row by row. Other columns of
    ``docs`` are not read. ``vocabulary``: the tokenizer file, at the same path on every worker.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)

    def work(ids, texts):
        known = _counter(path)
        for doc, text in zip(ids, texts, strict=True):
            words = Counter(words_of(text))
            known.learn(set(words))
            yield doc, len((text or "").encode()), sum(known[w] * n for w, n in words.items())

    kind = docs.schema[id_col].dataType.simpleString()
    counted = arrow_pass(docs.select(F.col(id_col), F.col(text_col)), work, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
