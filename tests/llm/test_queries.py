"""The registered queries over the smallest tables: against their SQL, or row by row against libraries and plain Python."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

from shopledger.llm import byte_bpe, registry
from shopledger.llm.common import load_ranks, tokenizer_path

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def documents():
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in table}


@pytest.mark.parametrize("name", sorted(set(registry.oracle_sql()) - {"op12_merkle_manifest"}))
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = registry.queries()[name](spark, SF).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_token_counts(spark, documents):
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    counts = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in documents.items()}
    got = rows_of(spark, "op1_token_counts")
    assert sorted(tuple(r)[:4] for r in got) == sorted((i, len(t.encode()), counts[i], counts[i] > 2048) for i, t in documents.items())


def test_byte_bpe(spark, documents):
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_ranks(tokenizer_path(byte_bpe.RANKS)), special_tokens={})
    want = []
    for i, t in documents.items():
        ids = encoding.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = rows_of(spark, "op9_byte_bpe")
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)


def test_packing(spark, documents):
    tokenizer = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces, bins = {}, {}
    for r in rows_of(spark, "op5_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in documents.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
        assert len(mine) == -(-len(ids) // 1024)
    assert not pieces
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_warc(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()}
    last = {data: i for i, data in sorted(pages.items())}
    want = []
    for i, data in pages.items():
        source = last[data] if last[data] != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if source else "response", source))
    got = rows_of(spark, "op6_warc")
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))


def test_sharding(spark, documents):
    got = rows_of(spark, "op7_sharding")
    size = {i: len(t.encode()) + 16 for i, t in documents.items()}
    group, load, slots = {}, {}, {}
    for r in got:
        assert (r.size, r.law, r.text_crc32) == (size[r.doc_id], "bytes", zlib.crc32(documents[r.doc_id].encode()))
        assert group.setdefault(documents[r.doc_id], r.shard) == r.shard and 0 <= r.shard < 40
        load[r.shard] = load.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(documents) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # the groups of equal texts in the order of their smallest ids: no contiguous cut into 40 has a smaller largest shard
    groups = {}
    for i, t in sorted(documents.items()):
        groups[t] = groups.get(t, 0) + size[i]
    sizes = list(groups.values())
    low, high = max(sizes), sum(sizes)
    while low < high:
        capacity, used, at = (low + high) // 2, 1, 0
        for n in sizes:
            used, at = (used + 1, n) if at + n > capacity else (used, at + n)
        low, high = (low, capacity) if used <= 40 else (capacity + 1, high)
    assert max(load.values()) == low


def test_quality_counts(spark, documents):
    from test_text_operators import base_counts

    for r in rows_of(spark, "op4_quality_rules"):
        n, chars, symbols, lines, repeat = base_counts(documents[r.doc_id])
        failed = n < 20 or 100 * repeat > 30 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeat, failed)
        assert not (r.kept and failed)
