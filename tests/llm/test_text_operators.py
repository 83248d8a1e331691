"""Row-wise operators against the libraries and plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN

from shopledger.llm import byte_bpe, packing, quality_rules, token_counts
from shopledger.llm.common import load_ranks, load_tokenizer, tokenizer_path


def by_key(rows):
    return sorted(map(repr, rows))


def test_token_counts(docs, texts, no_docs):
    tokenizer = load_tokenizer(tokenizer_path(token_counts.VOCABULARY))
    want = []
    for i, t in texts:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    got = [tuple(r) for r in token_counts.count_tokens(docs).collect()]
    assert by_key(got) == by_key(want)
    assert token_counts.count_tokens(no_docs).count() == 0


def test_single_tokens_are_proven():
    path = tokenizer_path(token_counts.VOCABULARY)
    found = token_counts.proven_single_tokens(path)
    assert len(found) > 10_000
    tokenizer = load_tokenizer(path)
    assert all(len(tokenizer.encode(s, add_special_tokens=False).ids) == 1 for s in list(found)[:500])


@pytest.mark.parametrize(("chunk", "overlap"), [(65_536, 512), (64, 16), (40, 8)])
def test_byte_bpe(docs, texts, chunk, overlap):
    encoding = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_ranks(tokenizer_path(byte_bpe.RANKS)), special_tokens={})
    encoded = byte_bpe.encode_documents(docs, chunk=chunk, overlap=overlap)
    got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect()]
    assert by_key(got) == by_key((i, encoding.encode_ordinary(t or "")) for i, t in texts)
    decoded = [(r.doc_id, bytes(r.bytes).decode()) for r in byte_bpe.decode_documents(encoded).collect()]
    assert by_key(decoded) == by_key((i, t or "") for i, t in texts)
    digests = {r.doc_id: r for r in byte_bpe.encode_documents(docs, chunk=chunk, overlap=overlap, digest=True).collect()}
    ids = encoding.encode_ordinary(texts[0][1])
    assert digests[1].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_byte_bpe_of_nothing(no_docs):
    assert byte_bpe.encode_documents(no_docs).count() == 0


def test_packing(docs, texts, no_docs):
    tokenizer = load_tokenizer(tokenizer_path(packing.VOCABULARY))
    packed = packing.pack_documents(docs, with_ids=True)
    rows = packed.collect()
    want = [(i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 2) for i, t in texts]
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id or 0, r.start)):
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4096
        whole.setdefault(r.doc_id, []).append(r)
    for i, *ids in want:
        if i != 2:  # a repeated row
            assert np.frombuffer(b"".join(bytes(r.ids) for r in whole[i]), "<u4").tolist() == ids
            assert len(whole[i]) == -(-len(ids) // 1024) and all(r.length == 1024 for r in whole[i][1:])
    assert sum(r.length for r in rows) == sum(len(w) - 1 for w in want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(len(ids) for ids in (r.ids for r in packing.sequences(packed).collect())) == sum(r.length for r in rows)
    assert packing.pack_documents(no_docs).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400).tolist()
    rooms = []
    for n in sorted(lengths, reverse=True):  # one by one
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(100 - n)
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.plan_best_fit(counts, 100)
    assert max(first + n for _, _, n, first, _ in plan) <= len(rooms)
    for n, c in counts.items():
        assert sorted(k for length, rank, m, _, _ in plan if length == n for k in range(rank, rank + m)) == list(range(c))


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, texts, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, None), (10, 0, 0), (11, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.score_documents(docs, labels).collect()
    want = []
    for i, t in texts:
        n, chars, symbols, lines, repeat = base_counts(t or "")
        want.append((i, n, chars, symbols, lines, repeat, n < 20 or 100 * repeat > 30 * n))
    assert by_key(tuple(r)[:7] for r in got) == by_key(want)
    assert all(r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD) for r in got)
    # the score, gram by gram
    good = [t for i, t in texts if i in (1, 3)]
    cells = lambda t: [(int.from_bytes(b[k : k + 4], "big") * 2654435761 % 2**32) >> 16 for b in [(t or "").encode()] for k in range(len(b) - 3)]
    raw, target = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    for _, t in texts:
        np.add.at(raw, cells(t), 1)
    for t in good:
        np.add.at(target, cells(t), 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    scores = {r.doc_id: r.score for r in got}
    for i, t in texts:
        if i in (1, 32, 34):
            assert scores[i] == pytest.approx(ratio[cells(t)].mean())
    assert quality_rules.score_documents(no_docs, labels).count() == 0
    nothing = quality_rules.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.0}
