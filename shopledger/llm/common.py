"""Helpers that several operators share: input tables, Arrow passes, words, and a cache of encoded text pieces."""

from __future__ import annotations

import json
import re
import tempfile
import zipfile
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space of the word rules: words are the longest runs of other bytes. ``bytes.split()`` cuts at exactly these.
WORD_SPACE = " \t\n\x0b\x0c\r"
#: The same as a Java pattern.
WORD_SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: A space inside a run of white space that is not the run's last character: pre-tokens may span it.
_INNER_SPACE = re.compile(r"\s (?:\s|$)")
#: A cheaper test that every such text meets.
_SPACE_AND_SPACE = re.compile(r" (?:\s|$)")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}_package.zip"  # read by the driver's file server only
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._llm_shipped = True


def arrow_pass(df: DataFrame, work: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """``df`` through ``work(*columns as Python lists)`` batch by batch; ``work`` yields rows of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(df.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in work(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                if len(rows) >= 20_000:
                    yield _to_batch(rows, arrow)
                    rows = []
            if rows:
                yield _to_batch(rows, arrow)

    return df.mapInArrow(run, schema)


def _to_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


class Workspace:
    """Intermediate tables of one operator in the shared folder, deleted as soon as no later step reads them.

    Whatever an operator returns is stored before the tables it came from go, so no lost task needs a deleted file.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """Write ``df`` once as Parquet and read it back."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path, compression=compression)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((stored, path))
        return stored

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        left = [(df, path) for df, path in self.paths if any(df is t for t in tables)]
        for path in {p for _, p in self.paths} - {p for _, p in left}:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths = left
        jvm.System.gc()  # Spark's cleaner removes shuffle files once the driver has collected the plans of finished writes


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def replace_column(df: DataFrame, key: str, column: str, new: DataFrame, new_value: str) -> DataFrame:
    """``df`` with ``column`` taken from ``new[new_value]`` where ``new`` has the row's key; other columns stay.

    The rows travel as one struct, so that no column name of ``df`` can clash with one of ``new``.
    """
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    values = new.select(F.col(key).alias("new_key"), F.col(new_value).alias("new_value"), F.lit(True).alias("new_found"))
    joined = packed.join(values, F.col("row").getField(key) == F.col("new_key"), "left")
    kept = [F.when(F.col("new_found"), F.col("new_value")).otherwise(F.col("row").getField(c)).alias(c) if c == column else F.col("row").getField(c).alias(c) for c in df.columns]
    return joined.select(*kept)


def cut_at_spaces(text: str) -> list[str] | None:
    """Pieces of ``text``, cut before single spaces, which a byte-level pattern encodes alone as it does in the text.

    Such a pattern ends a pre-token before every space that follows another character class, and before the last space of
    a run. Where a space lies inside a run of white space a pre-token may span the cut: then None, and the text is encoded whole.
    """
    if _SPACE_AND_SPACE.search(text) and _INNER_SPACE.search(text):
        return None
    head, *rest = text.split(" ")
    return [head, *[" " + w for w in rest]] if head else [" " + w for w in rest]


class PieceCache(dict):
    """What ``encode_many`` gives for text pieces seen by this worker, in two generations of at most ``most`` pieces.

    When the young one (this dict) is full it becomes the old one; what is still in use moves back, the rest is forgotten.
    """

    def __init__(self, encode_many: Callable[[list], list], most: int = 250_000):
        super().__init__()
        self.encode_many, self.most, self.old = encode_many, most, {}

    def learn(self, pieces: set) -> None:
        missing = [p for p in pieces if p not in self]
        if not missing:
            return
        if len(self) + len(missing) > self.most:
            self.old = dict(self)
            self.clear()
            missing = list(pieces)
        new = []
        for p in missing:
            if p in self.old:
                self[p] = self.old[p]
            else:
                new.append(p)
        if new:
            self.update(zip(new, self.encode_many(new), strict=True))


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """A tokenizer of the ``tokenizers`` library, once per worker and without threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a byte-level BPE: base64 bytes and rank, a line each."""
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def load_encoding(path: str):
    """The rank file as an encoding of the ``tiktoken`` library, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _merge_below(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of ``token`` after all merges of a lower rank than its own, lowest first, leftmost first."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def ranks_give_merges(vocabulary: str, ranks_file: str) -> bool:
    """Proof, over the whole vocabulary, that merging by ranks encodes every pre-token as merging by the vocabulary's list does.

    The list merges the pairs it names, in its order; ranks merge any two parts whose bytes are a token, lowest first. They
    agree if ids are ranks, each merge makes the token of the next id, and for every token the merges below its rank, inside
    its own bytes, end in just the pair that the list names for it: a merge of other parts into that token then never comes
    up, since whatever merges lie inside a token's bytes before it is made, are those of its bytes alone. Run once, in the
    driver: both vocabularies cut pre-tokens by the same pattern, which a test compares for every code point.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = json.load(file)
    model, alphabet, ranks = content["model"], byte_alphabet(), load_ranks(ranks_file)
    added = {t["id"] for t in content["added_tokens"]}
    ids = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if i not in added}
    plain = content["normalizer"] is None and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    if not plain or ids != ranks or len(model["merges"]) != sum(len(t) > 1 for t in ids) or sum(len(t) == 1 for t in ids) != 256:
        return False
    last = -1
    for pair in model["merges"]:
        left, right = (bytes(alphabet[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
        token = left + right
        if not ids.get(token, -1) > last or _merge_below(token, ranks) != [left, right]:
            return False
        last = ids[token]
    return True


#: Marks that, behind a word, are a pre-token of their own.
_MARKS = ",."
_LATIN_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def encode_pieces(encoding, parts: list[str]) -> list[bytes]:
    """Packed ids of text pieces. A word of Latin letters, with or without a mark behind it, needs no pattern match."""
    whole, single = encoding.encode_ordinary, encoding._encode_single_piece
    marks = {m: array("I", whole(m)).tobytes() for m in _MARKS}
    packed = []
    for part in parts:
        mark = part[-1:] if part[-1:] in marks else ""
        word = part[:-1] if mark else part
        if _LATIN_WORD.fullmatch(word):
            packed.append(array("I", single(word)).tobytes() + marks.get(mark, b""))
        else:
            packed.append(array("I", whole(part)).tobytes())
    return packed


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; each worker finds its own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)
