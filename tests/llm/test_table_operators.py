"""Operators over whole tables against brute force."""

import base64
import gzip
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shopledger.llm import fm_index, jaccard_join, line_dedup, sharding, substring_dedup, vector_search, warc


def one_per_id(texts):
    return {i: t for i, t in texts if i is not None}


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 40)])
def test_jaccard_join(docs, texts, no_docs, size, percent):
    sets = {i: shingle_set(t, size) for i, t in one_per_id(texts).items()}
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    got = jaccard_join.linked_documents(docs, words=size, percent=percent, cells=64).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), group[r.doc_id])
    assert jaccard_join.linked_documents(no_docs).count() == 0


@pytest.mark.parametrize("least", [1, 2, 3])
def test_line_dedup(docs, texts, no_docs, least):
    seen, want = set(), {}
    for i, t in sorted(one_per_id(texts).items()):
        if t is None:
            continue
        lines = t.split("\n")
        real = [k for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for k in range(len(real) - least + 1):
            run = tuple(lines[j] for j in real[k : k + least])
            if run in seen:
                gone |= set(real[k : k + least])
            seen.add(run)
        want[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    got = line_dedup.dedup_lines(docs, min_lines=least)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len(texts) and {r.kept for r in rows} == {"mine"}
    for r in rows:
        assert r.doc_id is None or r.text == want.get(r.doc_id)
    assert line_dedup.dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize(("window", "gram", "hot"), [(20, 6, 20_000), (20, 6, 1), (5, 2, 20_000), (3, 2, 2)])
def test_substring_dedup(docs, texts, no_docs, window, gram, hot):
    seen, want = {}, {}
    words = {i: (t or "").encode().split() for i, t in one_per_id(texts).items()}
    for i, w in sorted(words.items()):
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone |= set(range(k, k + window))
            seen.setdefault(key, (i, k))
        want[i] = gone
    found = substring_dedup.repeated_intervals(docs.select("doc_id", "text"), window, gram, hot, shard_segments=5).collect()
    got = {r.doc_id: {k for s in r.intervals for k in range(s.start, s.end)} for r in found}
    assert got == {i: g for i, g in want.items() if g}
    assert substring_dedup.dedup_substrings(no_docs).count() == 0


def test_substring_dedup_keeps_columns(docs, texts):
    rows = substring_dedup.dedup_substrings(docs)
    assert rows.columns == docs.columns
    text = {r.doc_id: r.text for r in rows.collect()}
    given = one_per_id(texts)
    assert rows.count() == len(texts) and text[2] == "" and text[1] == given[1] and text[4] is None and text[6] == given[6]


def test_fm_index_finds_every_repeat():
    rng = np.random.default_rng(1)
    symbols = np.append(rng.integers(1, 6, 3000), 0)
    symbols[rng.integers(0, 3000, 100)] = 0
    starts = np.array([s for s in range(2990) if not (symbols[s : s + 7] == 0).any()])
    index = fm_index.FMIndex(symbols, 7)
    low, high = index.repeated(symbols, starts, 7)
    counts = Counter(tuple(symbols[s : s + 7]) for s in range(len(symbols) - 6))
    for s, a, b in zip(starts, low, high, strict=True):
        n = counts[tuple(symbols[s : s + 7])]
        assert b - a == (n if n > 1 else 0)
        assert all(tuple(symbols[o : o + 7]) == tuple(symbols[s : s + 7]) for o in index.order[a:b])


def test_vector_search(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist(), "x") for i in range(150)]
    rows += [(200, rows[0][1], "x"), (201, rows[0][1], "x"), (202, None, "x"), (203, [None] * 8, "x"), (204, [float("nan")] * 8, "x"), (205, [float("inf")] * 8, "x"), (206, [1.0, 2.0], "x"), (207, [], "x"), (None, rows[1][1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(4)
    good = {i: np.floor(np.array(v) * 256).astype(int) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q in (i for i in good if i % 50 == 0):
        scored = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = vector_search.top_k(df, df.filter("vec_id % 50 = 0"), block=16, query_block=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = df.filter("vec_id in (0, 1, 2)")
    assert vector_search.top_k(few, few.filter("vec_id = 0")).count() == 2
    assert vector_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_vector_search_of_large_components_and_many_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=40).tolist()) for i in range(300)]
    rows += [(400, [2.0**40 + k for k in range(40)]), (401, [-(2.0**40)] * 40), (402, [1e17] * 40), (403, [1e300] * 40), (450, [3e16] * 40), (500, [0.0] * 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = {i: [math.floor(x * 256) if abs(x) < 1e15 else int(x * 256) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
        limit = 10**38 - 1  # larger ones are ties
        scored = sorted((max(-limit, min(limit, s)), i) for s, i in scored)[:5]
        want += [(q, k + 1, i, -s if -(2**63) <= -s < 2**63 else None) for k, (s, i) in enumerate(scored)]
    got = vector_search.top_k(df, df.filter("vec_id % 50 = 0"), block=32, query_block=3, batch=4)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert any(r[3] is None for r in want)


def test_bounds_thin_out_structured_vectors(spark):
    rng = np.random.default_rng(6)
    data = np.repeat(rng.normal(size=(600, 4)) * 20, 16, axis=1) + rng.normal(size=(600, 64)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    whole = np.floor(data * 256).astype(np.int64)
    want = []
    for q in range(0, 600, 50):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in range(600) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert sorted(map(tuple, vector_search.top_k(df, df.filter("vec_id % 50 = 0"), block=100, query_block=5).collect())) == sorted(want)
    q, x = (vector_search.Block(np.arange(a, b).tobytes(), whole[a:b].astype(float).tobytes(), 64) for a, b in ((0, 10), (10, 600)))
    floors = np.sort(q.x @ x.x.T, axis=1)[:, -5]
    bounds = q.levels[0] @ x.levels[0].T
    assert (bounds >= floors[:, None]).mean() < vector_search.WEAK  # the coarse level alone drops most pairs
    found = vector_search.surviving_pairs(q, x, floors)
    assert len(found[0]) == 50 and (found[2] >= floors[found[0]]).all()


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é b", "<p>one</p>"), (2, None, None), (3, "u", ""), (4, "http://c\r\nX: y", "<p>one</p>"), (5, "d", "\r\n\r\nWARC/1.0\r\n"), (9, "e", "<p>one</p>"), (None, "f", "<p>one</p>"), (6, "g", "é" * 70_000), (9, "e", "<p>one</p>")]
    pages = spark.createDataFrame([(*r, "k", 0) for r in rows], "page_id long, url string, html string, payload_key string, n int").repartition(2)
    index, folder = warc.archive_pages(pages)
    got = warc.read_records(index, folder, range_bytes=100).collect()
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        source = last[html or ""] if i is not None and last[html or ""] > i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if source else "response", source))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {h or "" for _, _, h in rows}
    store, base = warc.open_store(folder)
    from pyarrow import fs

    whole = b"".join(gzip.decompress(store.open_input_stream(f.path, compression=None).read()) for f in store.get_file_info(fs.FileSelector(base)))
    assert whole.count(b"WARC/1.0\r\nWARC-Type") == len(rows)
    assert warc.read_records(*warc.archive_pages(pages.limit(0))).count() == 0


def brute_capacity(sizes, shards):
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, at = 1, 0
        for n in sizes:
            if at + n > capacity:
                used, at = used + 1, 0
            at += n
        if used <= shards:
            return capacity


def test_sharding(docs, texts, no_docs):
    rows = sharding.shard_documents(docs, shards=4).collect()
    assert len(rows) == len(texts)
    size = {i: len((t or "").encode()) + 16 for i, t in texts}
    group, slots = {}, {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.law == "bytes" and 0 <= r.shard < 4 and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
        text = next(t for i, t in texts if i == r.doc_id) or ""
        assert r.text_crc32 == zlib.crc32(text.encode()) and group.setdefault(text, r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_smallest_capacity(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 300).tolist()
    if seed == 2:
        sizes[100] = 4000
    upto = np.cumsum(sizes).tolist()
    groups = spark.createDataFrame(list(zip(sizes, upto, strict=True)), "bytes long, upto long")
    capacity, ends = sharding.shard_cuts(groups, 12, cells=16)
    assert capacity == brute_capacity(sizes, 12)
    cuts = [0, *ends]
    assert ends[-1] == upto[-1] and set(ends) <= set(upto) and all(0 <= b - a <= capacity for a, b in itertools.pairwise(cuts))


def test_pipeline_deletes_single_repeated_lines(spark):
    import corpus_pipeline

    rows = [(1, "a b\nfooter\nc d"), (2, "e f\nfooter\ng h"), (3, "one line"), (4, "one line"), (5, "footer\n\ni j\nfooter")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got == {1: "a b\nfooter\nc d", 2: "e f\ng h", 3: "one line", 4: "", 5: "\ni j"}
