"""Cross-tokenizer alignment: the tokens of two vocabularies over the same bytes, by merge-path partitioning.

Tokens. A text with a space before it is encoded whole by both vocabularies. A's ids come from the rank form of the same
vocabulary where a proof over all its entries holds, else from the vocabulary file itself. The ends of the tokens are two
ascending lists of byte offsets that finish at the same one.

Partitioning. The merge of both lists is cut on its diagonals: a binary search on every ``PIECE_ENDS``-th diagonal finds how
many ends of A and of B lie before it, without merging anything. Pieces so hold equally many ends, whatever the text's length
and however uneven its tokens are; ends at the same byte stay in one piece. The pieces are rows of a stored table, so the
work is dealt by ends and not by documents. A piece also holds the token of each side that reaches beyond its last end.

Merging. A piece merges its ends. Every distinct end closes one overlap of an A and a B token: that is a link. Ends common to
both close a group. What stands before a piece's first common end and behind its last one belongs to groups that neighbours
share; these are stitched per document, in the order of its pieces.

Counts. Links are counted per pair of ids over all pieces. The most frequent pairs (``FREQUENT`` at most) and the highest
count of each B id (one per entry of the vocabulary) go to every task; links of rarer pairs meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_pass, byte_alphabet, load_encoding, ranks_give_merges, read_table, ship_package, tokenizer_path

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: The same vocabulary as A, as ranks.
RANKS_A = "byte_bpe_50k.tiktoken"
#: Token ends of one piece, of both sides together.
PIECE_ENDS = 1 << 15
#: Pairs whose counts go to every task (12 bytes each), at most; the counts of the others are joined.
FREQUENT = 1 << 19
#: Steps per doubling of the count on the scale by which the frequent pairs are chosen.
_SCALE = 16
#: Links that a task counts at once.
_COUNTED = 1 << 22

_SPACE = "▁"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class Vocabularies:
    """Both vocabularies with the bytes of their entries. ``twin`` is the rank file of A, if it is proven to give the same ids."""

    def __init__(self, path_a: str, path_b: str, twin: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.twin = load_encoding(twin) if twin else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        tokens = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in known], np.int64) for known in (self.a_bytes, self.b_bytes))
        #: How ids are packed.
        self.kind = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4"

    def encode_a(self, text: str) -> list[int]:
        return self.twin.encode_ordinary(text) if self.twin else self.a.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Packed ids of both sides; none for null and empty texts and where the bytes of either side are not those of the text."""
        if not text:
            return b"", b""
        spaced = " " + text
        whole, a, b = spaced.encode(), self.encode_a(spaced), self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return b"", b""
        return np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()

    @lru_cache(maxsize=1)  # noqa: B019 (lives as long as the worker)
    def strings(self) -> list[str]:
        """For each A id its digits with a comma and with a bar behind, for each B id with a comma and with a semicolon."""
        return [f"{i}{mark}" for i in range(len(self.a_bytes)) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.b_bytes)) for mark in ",;"]


@lru_cache(maxsize=2)
def load_vocabularies(path_a: str | None, path_b: str | None) -> Vocabularies:
    """Both vocabularies, once per worker; without a path the public ones. The rank form of A is proven equal beforehand."""
    return Vocabularies(path_a or tokenizer_path(VOCABULARY_A), path_b or tokenizer_path(VOCABULARY_B), None if path_a else tokenizer_path(RANKS_A))


def merge_path_cuts(a: np.ndarray, b: np.ndarray, work: int) -> np.ndarray:
    """Rows (ends of A, ends of B) before each cut, from (0, 0) to both lengths: about ``work`` ends lie between two.

    In the merge, A comes first at equal ends; a cut never parts equal ends.
    """
    diagonals = np.arange(work, len(a) + len(b), work)
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (searching := low < high).any():
        middle = (low + high) // 2
        before = np.zeros_like(searching)  # the end of A at ``middle`` comes before the diagonal
        before[searching] = a[middle[searching]] <= b[(diagonals - middle - 1)[searching]]
        low, high = np.where(before, middle + 1, low), np.where(searching & ~before, middle, high)
    i, j = low, diagonals - low
    inner = (i > 0) & (j < len(b))
    j[inner] += a[i[inner] - 1] == b[j[inner]]
    return np.unique(np.concatenate([[[0, 0]], np.stack([i, j], axis=1), [[len(a), len(b)]]]), axis=0)


_PIECES = "row long, doc_id long, piece int, pieces int, a binary, b binary, n_a int, n_b int, a_start long, b_start long"


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path_a: str | None, path_b: str | None, work: int) -> DataFrame:
    """Pieces of equal work of every document's token ends; one without ends for a document without tokens."""

    def cut(rows, ids, texts):
        known = load_vocabularies(path_a, path_b)
        size = np.dtype(known.kind).itemsize
        for row, i, text in zip(rows, ids, texts, strict=True):
            a, b = known.encode(text)
            if len(a) + len(b) <= work * size:
                yield row, i, 0, 1, a, b, len(a) // size, len(b) // size, 0, 0
                continue
            a_ends, b_ends = np.cumsum(known.a_lengths[np.frombuffer(a, known.kind)]), np.cumsum(known.b_lengths[np.frombuffer(b, known.kind)])
            cuts = merge_path_cuts(a_ends, b_ends, work).tolist()
            for k, ((i0, j0), (i1, j1)) in enumerate(zip(cuts, cuts[1:], strict=False)):
                starts = int(a_ends[i0 - 1]) if i0 else 0, int(b_ends[j0 - 1]) if j0 else 0
                yield row, i, k, len(cuts) - 1, a[i0 * size : (i1 + 1) * size], b[j0 * size : (j1 + 1) * size], i1 - i0, j1 - j0, *starts

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(numbered, cut, _PIECES)


class Merged:
    """The merge of one piece: its links and, of its own ends, those that close groups."""

    def __init__(self, known: Vocabularies, a: bytes, b: bytes, n_a: int, n_b: int, a_start: int, b_start: int):
        self.known, self.n_a, self.n_b = known, n_a, n_b
        self.a, self.b = np.frombuffer(a, known.kind), np.frombuffer(b, known.kind)
        a_ends, b_ends = a_start + np.cumsum(known.a_lengths[self.a]), b_start + np.cumsum(known.b_lengths[self.b])
        self.own_a, self.own_b = a_ends[:n_a], b_ends[:n_b]
        merged = np.concatenate([self.own_a, self.own_b])
        merged.sort(kind="stable")  # two ascending runs
        again = merged[1:] == merged[:-1]
        self.common = merged[1:][again]
        ends = merged[np.append(np.ones(min(len(merged), 1), bool), ~again)]
        # the token of each side that covers the bytes before an end: the first one that does not end earlier
        self.links = self.a[np.searchsorted(a_ends, ends)].astype(np.int64) * len(known.b_bytes) + self.b[np.searchsorted(b_ends, ends)]

    def groups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes of ``strings`` in the order of the group text, group of each A token, group of each B token)."""
        group_a, group_b = np.searchsorted(self.common, self.own_a), np.searchsorted(self.common, self.own_b)
        last_a, last_b = np.isin(self.own_a, self.common, assume_unique=True), np.isin(self.own_b, self.common, assume_unique=True)
        codes = np.empty(self.n_a + self.n_b, np.int64)
        codes[np.arange(self.n_a) + np.searchsorted(group_b, group_a)] = 2 * self.a[: self.n_a].astype(np.int64) + last_a
        codes[np.arange(self.n_b) + np.searchsorted(group_a, group_b, side="right")] = 2 * (len(self.known.a_bytes) + self.b[: self.n_b].astype(np.int64)) + last_b
        return codes, group_a, group_b

    def text(self, codes: np.ndarray) -> str:
        return "".join(map(self.known.strings().__getitem__, codes.tolist()))

    def fragments(self) -> dict:
        """The group text in parts: both sides of the first group, the whole groups behind it, both sides of the open rest."""
        codes, group_a, group_b = self.groups()
        closed = len(self.common)

        def side(ids: np.ndarray, group: np.ndarray, which: int) -> str:
            return "".join([f"{i}," for i in ids[: len(group)][group == which].tolist()])

        first = int((group_a == 0).sum() + (group_b == 0).sum()) if closed else 0
        rest = int((group_a == closed).sum() + (group_b == closed).sum())
        return {
            "head_a": side(self.a, group_a, 0) if closed else "",
            "head_b": side(self.b, group_b, 0) if closed else "",
            "middle": self.text(codes[first : len(codes) - rest]),
            "tail_a": side(self.a, group_a, closed),
            "tail_b": side(self.b, group_b, closed),
            "closed": closed > 0,
        }


def stitch(parts: list[dict]) -> str:
    """The group text of a document from the fragments of its pieces, in order."""
    text, open_a, open_b = [], "", ""
    for part in parts:
        if part["closed"]:
            text += [(open_a + part["head_a"])[:-1], "|", (open_b + part["head_b"])[:-1], ";", part["middle"]]
            open_a = open_b = ""
        open_a, open_b = open_a + part["tail_a"], open_b + part["tail_b"]
    return "".join(text)[:-1]


def _rows(batch: pa.RecordBatch, known: Vocabularies) -> Iterator[tuple[dict, Merged]]:
    for r in batch.to_pylist():
        yield r, Merged(known, r["a"], r["b"], r["n_a"], r["n_b"], r["a_start"], r["b_start"])


def pair_counts(pieces: DataFrame, path_a: str | None, path_b: str | None) -> DataFrame:
    """(link, n): how many links of all pieces hold each pair of ids; a link is A id x size of B + B id."""
    ship_package(pieces.sparkSession)

    def flush(links: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(links), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["link", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, waiting = load_vocabularies(path_a, path_b), [], 0
        for batch in batches:
            for _, merged in _rows(batch, known):
                links.append(merged.links)
                waiting += len(merged.links)
                if waiting >= _COUNTED:
                    yield flush(links)
                    links, waiting = [], 0
        if links:
            yield flush(links)

    return pieces.mapInArrow(count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def frequent_from(pairs: DataFrame, most: int) -> int:
    """The step of the count scale from which on at most ``most`` pairs lie: a row per step is collected."""
    steps = pairs.groupBy(_step().alias("step")).agg(F.count("*").alias("pairs")).orderBy(F.desc("step")).collect()
    total, lowest = 0, 64 * _SCALE
    for r in steps:
        total += r["pairs"]
        if total > most:
            break
        lowest = r["step"]
    return lowest


def _step():
    return F.floor(F.log2("n") * _SCALE).cast("int")


_SCORED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_PARTS = "struct<piece:int,head_a:string,head_b:string,middle:string,tail_a:string,tail_b:string,closed:boolean>"


def score_pieces(pieces: DataFrame, frequent: tuple[np.ndarray, np.ndarray], best: np.ndarray, path_a: str | None, path_b: str | None) -> DataFrame:
    """Per piece: its numbers, the links whose pair is not ``frequent``, and the group text's digest or its parts."""
    known_counts = pieces.sparkSession.sparkContext.broadcast((*frequent, best))

    def score(row, doc_id, piece, n_pieces, a, b, n_a, n_b, a_start, b_start):
        known = load_vocabularies(path_a, path_b)
        links, counts, highest = known_counts.value
        for r in zip(row, doc_id, piece, n_pieces, a, b, n_a, n_b, a_start, b_start, strict=True):
            merged = Merged(known, *r[4:])
            place = np.minimum(np.searchsorted(links, merged.links), max(len(links) - 1, 0))
            hit = links[place] == merged.links if len(links) else np.zeros(len(merged.links), bool)
            n = counts[place[hit]]
            top = highest[merged.links[hit] % len(known.b_bytes)]
            digest, parts = None, None
            if r[3] > 1:
                parts = {"piece": r[2], **merged.fragments()}
            else:
                digest = hashlib.sha256(merged.text(merged.groups()[0])[:-1].encode()).hexdigest() if r[6] else ""
            numbers = (r[6], r[7], len(merged.common), len(merged.links), int((n == top).sum()), int(n.sum()))
            yield *r[:2], *numbers, digest, merged.links[~hit].tolist(), parts

    return arrow_pass(pieces, score, f"{_SCORED}, rare array<long>, parts {_PARTS}")


def align_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_a: str | None = None,
    path_b: str | None = None,
    work: int = PIECE_ENDS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links whose pair is the most frequent one of its B id in all of ``docs`` (ties included),
    ``count_sum`` adds the corpus-wide counts of the pairs of all links. Null and empty texts, and texts that either side does
    not give back byte for byte, have no tokens: zeros and an empty digest. Very long texts are several pieces. Rows that repeat
    an id or are equal are documents of their own, and count as often; a null id stays null. Other columns are not read. An
    empty table gives an empty result.
    """
    if path_a is None and not ranks_give_merges(tokenizer_path(VOCABULARY_A), tokenizer_path(RANKS_A)):
        path_a = tokenizer_path(VOCABULARY_A)  # named: encoded by its own library
    space = Workspace(docs.sparkSession)
    pieces = space.table(token_pieces(docs, id_col, text_col, path_a, path_b, work), "tokens", compression="zstd")
    pairs = space.table(pair_counts(pieces, path_a, path_b), "pairs")
    lowest = frequent_from(pairs, frequent)
    size_b = len(load_vocabularies(path_a, path_b).b_bytes)
    most = pairs.groupBy((F.col("link") % size_b).alias("b")).agg(F.max("n").alias("most"))  # a row per entry of B at most
    by_link = pairs.filter(_step() >= lowest).orderBy("link").toArrow()
    highest = most.toArrow()
    best = np.zeros(size_b, np.int64)
    best[highest["b"].to_numpy()] = highest["most"].to_numpy()
    scored = space.table(score_pieces(pieces, (by_link["link"].to_numpy(), by_link["n"].to_numpy()), best, path_a, path_b), "scored")
    space.keep(pairs, scored)

    rare = scored.filter(F.size("rare") > 0).select("row", F.explode("rare").alias("link")).join(pairs.filter(_step() < lowest), "link")
    rare = rare.join(F.broadcast(most), F.col("link") % size_b == F.col("b"))
    stitched = scored.filter(F.col("parts").isNotNull()).groupBy("row").agg(F.array_sort(F.collect_list("parts")).alias("parts"))

    def digests(rows, lists):
        for row, parts in zip(rows, lists, strict=True):
            yield row, hashlib.sha256(stitch(parts).encode()).hexdigest()

    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    found = scored.select("row", "doc_id", *numbers, "groups_sha256")
    found = found.unionByName(rare.select("row", F.col("n").alias("count_sum"), (F.col("n") == F.col("most")).cast("long").alias("n_best")), allowMissingColumns=True)
    found = found.unionByName(arrow_pass(stitched, digests, "row long, groups_sha256 string"), allowMissingColumns=True)
    summed = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in numbers], F.max("groups_sha256").alias("groups_sha256"))
    return summed.drop("row")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of both vocabularies, groups and links between them, and how usual the links are."""
    return align_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op11_alignment": op11_alignment}
#: No SQL form: the vocabularies are files of other libraries. Tested against brute force.
ORACLE_SQL: dict[str, str] = {}
