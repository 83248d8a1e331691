"""SimHash near-dedup by bit-sliced comparison.

Fingerprints. Each text's word shingles, repeats included, are hashed by XXH64; a bit of the fingerprint is 1 if it is set in
over half of the hashes. Equal fingerprints are one class from then on, so a group of copies is one row.

Buckets. The 64 bits are cut into ``RADIUS + 2`` parts. Two fingerprints that differ in at most ``RADIUS`` bits agree in two
parts at least, so each is listed under every pair of parts. A bucket of more than ``BUCKET`` fingerprints is dealt on: what
its key leaves open is cut and paired again. The key then holds 48 of the 64 bits, so that no group can have more than 2^16
different fingerprints, whatever the data are. No bucket is left out, none is expanded into its pairs.

Comparison. A task takes its buckets in the order of their keys, packed into blocks of lanes. A block stores bit planes
vertically: plane ``p`` holds bit ``p`` of all lanes. A batch of fingerprints updates its distances to all lanes, 64 at a
time, with carry-save counters (one word per binary digit, and one for "beyond the radius"), plane after plane; a fingerprint
leaves the batch once all lanes of the block exceed the radius. What is found is reduced to one link per fingerprint and pack,
to the smallest one it reaches there. Connected components of these links are the classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, arrow_pass, read_table, ship_package
from .components import components

WORDS = 3
SEED = 42
RADIUS = 2
#: A bucket with more fingerprints is dealt on by the bits that its key leaves open.
BUCKET = 4096
#: Lanes of a block; fingerprints compared with it at once.
LANES = 512
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of one text; 0 without words."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: lower-cases A-Z, cuts at ASCII white space
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) <= words else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp): a row per document; the fingerprint as a signed long."""

    def work(ids, texts):
        for i, text in zip(ids, texts, strict=True):
            fp = fingerprint(text, words)
            yield i, fp - (1 << 64) if fp >> 63 else fp

    return arrow_pass(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, fp long")


def _gather(value: Column, fields: list[tuple[int, int]]) -> Column:
    """The bit fields (offset, width) of ``value``, side by side from bit 0."""
    out, at = F.lit(0).cast("long"), 0
    for offset, width in fields:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(value, offset).bitwiseAND(F.lit((1 << width) - 1)), at))
        at += width
    return out


def _listings(value: Column, width: int, parts: int) -> tuple[list[tuple[Column, Column]], int, int]:
    """For every two of ``parts`` parts of a ``width``-bit value: (number of the pair and both parts, the other bits).

    With the number of bits of the keys and of the other bits, at most.
    """
    edges = [width * k // parts for k in range(parts + 1)]
    fields = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    pairs = list(combinations(range(parts), 2))
    inside = max(fields[i][1] + fields[j][1] for i, j in pairs)
    found = []
    for k, pair in enumerate(pairs):
        key = _gather(value, [fields[i] for i in pair]).bitwiseOR(F.lit(k << inside))
        found.append((key, _gather(value, [f for i, f in enumerate(fields) if i not in pair])))
    return found, inside + len(pairs).bit_length(), width - min(fields[i][1] + fields[j][1] for i, j in pairs)


def shared_buckets(classes: DataFrame, radius: int, bucket: int, space: Workspace) -> DataFrame:
    """(key, fp): fingerprints under every key that another one shares, hot keys dealt on. ``classes`` (fp) has each once."""
    first, _, open_bits = _listings(F.col("fp"), 64, radius + 2)
    listed = classes.select("fp", F.explode(F.array(*[F.struct(k.alias("key"), r.alias("rest")) for k, r in first])).alias("at")).select("fp", "at.*")
    shared = listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = space.table(listed.join(shared, "key"), "buckets")
    again, bits, _ = _listings(F.col("rest"), open_bits, radius + 2)
    dealt = F.explode(F.array(*[(-F.shiftleft(F.col("key"), bits).bitwiseOR(k) - 1).alias("key") for k, _ in again])).alias("key")
    return rows.filter(F.col("n") <= bucket).select("key", "fp").union(rows.filter(F.col("n") > bucket).select(dealt, "fp"))


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose binary count is above ``radius``."""
    above, equal = over.copy(), np.full_like(over, _FULL)
    for digit in reversed(range(len(counters))):
        if not radius >> digit & 1:
            above |= equal & counters[digit]
            equal &= ~counters[digit]
        else:
            equal &= counters[digit]
    return above


def near_lanes(planes: np.ndarray, pad: np.ndarray, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(probes, lanes) within ``radius`` bits. ``planes`` (64, words): bit p of all lanes; ``pad``: lanes that are none."""
    left = np.arange(len(probes))
    over = np.tile(pad, (len(probes), 1))
    counters = [np.zeros_like(over) for _ in range(radius.bit_length())]
    for plane in range(64):
        differ = planes[plane][None, :] ^ (np.uint64(0) - (probes >> np.uint64(plane) & np.uint64(1)))[:, None]
        for counter in counters:  # add one bit to each lane's count
            carry = counter & differ
            counter ^= differ
            differ = carry
        over |= differ
        if plane % 8 == 7 and plane >= 15:
            open_rows = (_beyond(counters, over, radius) != _FULL).any(axis=1)
            if not open_rows.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if 2 * open_rows.sum() < len(open_rows):
                left, probes, over, counters = left[open_rows], probes[open_rows], over[open_rows], [c[open_rows] for c in counters]
    near = ~_beyond(counters, over, radius)
    row, lane = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(len(left), -1), axis=1, bitorder="little"))
    return left[row], lane


def near_pairs(values: np.ndarray, radius: int, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of ``values`` (uint64) within ``radius`` bits, block by block."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for start in range(0, len(values), lanes):
        block = np.zeros(lanes, "<u8")
        part = values[start : start + lanes]
        block[: len(part)] = part
        bits = np.unpackbits(block.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
        pad = np.packbits(np.arange(lanes) >= len(part), bitorder="little").view("<u8")
        for low in range(0, start + len(part), lanes):
            row, lane = near_lanes(planes, pad, values[low : min(low + lanes, start + len(part))], radius)
            earlier = row + low < lane + start
            found.append((row[earlier] + low, lane[earlier] + start))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of 0..n-1 the smallest number that the links reach."""
    label = np.arange(n)
    while len(a):
        new, low = label.copy(), np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b): each fingerprint of a pack of buckets with the smallest one it reaches there. ``buckets`` (key, fp)."""
    ship_package(buckets.sparkSession)
    schema = "a long, b long"

    def links(values: np.ndarray) -> pa.RecordBatch:
        values = np.unique(values)
        root = values[smallest_reachable(len(values), *near_pairs(values.view("<u8"), radius))]
        moved = root != values
        return pa.RecordBatch.from_arrays([pa.array(root[moved]), pa.array(values[moved])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, batch.column(1).to_numpy(zero_copy_only=False)])
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
            at = 0
            for start in starts:  # whole buckets, as many as fill the lanes of a block
                if start - at >= LANES:
                    yield links(values[at:start])
                    at = start
            keys, values = keys[at:], values[at:]
        if len(keys):
            yield links(values)

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(compare, schema)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of ``docs``; 16 hex digits, and the smallest id linked with it.

    Rows link when their fingerprints differ in at most ``radius`` (1 or 2) bits; components are closed under links. Null,
    empty and blank texts have the fingerprint zero and link like any other. Each row is judged by its own text: rows that
    repeat an id stay as they are. A row with a null id has a fingerprint; it takes no part in links and its component is
    null. Texts are taken whole, however long. Other columns are not read. An empty table gives an empty result.
    """
    if radius not in (1, 2):
        raise ValueError("the bound on a bucket is proven for a radius of 1 or 2 bits")
    space = Workspace(docs.sparkSession)
    marks = space.table(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = space.table(marks.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links = space.table(near_links(shared_buckets(classes.select("fp"), radius, bucket, space), radius), "near")
    space.keep(marks, classes, links)
    roots = components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = space.table(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return marks.join(named, "fp", "left").select("doc_id", digits.alias("fingerprint"), component.alias("component_id"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its SimHash of three-word shingles and the component at 2 or fewer differing bits."""
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op13_simhash": op13_simhash}
#: No SQL form: DuckDB has no XXH64. Tested against brute force.
ORACLE_SQL: dict[str, str] = {}
