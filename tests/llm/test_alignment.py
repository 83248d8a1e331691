"""Cross-tokenizer alignment against a plain walk over bytes."""

import hashlib
import json
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shopledger.llm import alignment
from shopledger.llm.common import ranks_give_merges, tokenizer_path

ODD = ["a  b", " lead", "trail ", "tab\t x", "n\n\n m", "▁ piece", "ﬁ ﷺ Å", "　wide a b", "<0x41> <s> </s>", "x" * 3000, " ", "\n", "\x1c \x00", "it's 'll x"]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(tokenizer_path(alignment.VOCABULARY_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.VOCABULARY_B))
    back = {c: x for x, c in _bytes_to_characters().items()}

    def tokens(text):
        left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
        return left, right

    return tokens


def _bytes_to_characters():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(rest)}


def walk(text, tokens):
    """(A ids, B ids, groups as (A ids, B ids), links as (A id, B id))"""
    if not text:
        return [], [], [], []
    a, b = tokens(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], [], [], []
    owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (a, b)]
    links = sorted(set(zip(*owner, strict=True)))
    groups, i, j = [], [], []
    for at in range(len(whole)):
        for own, found in zip(owner, (i, j), strict=True):
            if not found or found[-1] != own[at]:
                found.append(own[at])
        if at + 1 == len(whole) or (owner[0][at] != owner[0][at + 1] and owner[1][at] != owner[1][at + 1]):
            groups.append(([a[k][0] for k in i], [b[k][0] for k in j]))
            i, j = [], []
    return [i for i, _ in a], [i for i, _ in b], groups, [(a[i][0], b[j][0]) for i, j in links]


def brute(rows, tokens):
    walked = [(i, walk(t, tokens)) for i, t in rows]
    count = Counter(link for _, (*_, links) in walked for link in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for i, (a, b, groups, links) in walked:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        yield i, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest


@pytest.mark.parametrize(("work", "frequent"), [(1 << 15, 1 << 19), (2, 0), (7, 50), (64, 1 << 19)])
def test_align_documents(spark, docs, texts, no_docs, sides, work, frequent):
    rows = [*texts, *((100 + k, t) for k, t in enumerate(ODD))]
    more = spark.createDataFrame([(i, t, "en", None, 0, "mine", "mine", "mine") for i, t in rows[len(texts) :]], docs.schema)
    got = alignment.align_documents(docs.union(more), work=work, frequent=frequent)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, sides)))
    if work == 7:
        assert alignment.align_documents(no_docs, work=work, frequent=frequent).count() == 0


def test_merge_path_cuts():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(1, 80, rng.integers(1, 40))) for _ in range(2))
        a, b = (np.append(x[x < 80], 80) for x in (a, b))
        cuts = alignment.merge_path_cuts(a, b, 5).tolist()
        assert cuts[0] == [0, 0] and cuts[-1] == [len(a), len(b)]
        for (i0, j0), (i1, j1) in zip(cuts, cuts[1:], strict=False):
            assert i0 <= i1 and j0 <= j1 and 0 < i1 - i0 + j1 - j0 <= 6
            assert max([0, *a[:i1], *b[:j1]]) < min([81, *a[i1:], *b[j1:]])


def test_ranks_are_proven_for_the_vocabulary(tmp_path):
    paths = tokenizer_path(alignment.VOCABULARY_A), tokenizer_path(alignment.RANKS_A)
    assert ranks_give_merges(*paths)
    known = alignment.load_vocabularies(None, None)
    assert len(known.a_bytes) == 50_257 and known.kind == "<u2" and known.twin is not None
    content = json.loads(Path(paths[0]).read_text())
    merges = content["model"]["merges"]
    merges[300], merges[301] = merges[301], merges[300]
    (tmp_path / "other.json").write_text(json.dumps(content))
    assert not ranks_give_merges(str(tmp_path / "other.json"), paths[1])


def test_both_libraries_cut_alike_at_every_code_point():
    """The pattern names letters, numbers and white space: each code point in the company of each."""
    a = Tokenizer.from_file(tokenizer_path(alignment.VOCABULARY_A))
    twin = alignment.load_vocabularies(None, None).twin
    for low in range(0, 0x110000, 0x8000):
        found = [f"a{c}a 1{c}1 .{c}. {c} {c}{c}" for c in map(chr, range(low, low + 0x8000)) if not 0xD800 <= ord(c) < 0xE000]
        if found:
            assert [e.ids for e in a.encode_batch(found, add_special_tokens=False)] == [twin.encode_ordinary(t) for t in found]


def test_named_vocabularies_are_encoded_by_their_own_library(spark, docs):
    own = tokenizer_path(alignment.VOCABULARY_A)
    few = docs.filter("doc_id in (1, 30, 31)")
    assert sorted(map(tuple, alignment.align_documents(few, path_a=own).collect())) == sorted(map(tuple, alignment.align_documents(few).collect()))


def test_query_reads_the_whole_table(spark, sides):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = alignment.op11_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, sides))
