"""The Merkle manifest against a plain tree."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from shopledger.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, pos long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The root, and for each node the (left, right) digests of every level."""
    paths, level, height = [[] for _ in nodes], nodes, 0
    while len(level) > 1:
        for k, path in enumerate(paths):
            at = k // 8**height
            run = range(at - at % 8, min(at - at % 8 + 8, len(level)))
            path.append(("".join(level[i] for i in run if i < at), "".join(level[i] for i in run if i > at)))
        level, height = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)], height + 1
    return level[0], paths


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, subs = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        sub, paths = tree([leaf_of(r) for r in own])
        trees[lang] = list(zip(own, paths, strict=True))
        subs.append(sub)
    root, tops = tree(subs)
    for lang, sub, top in zip(langs, subs, tops, strict=True):
        for row, path in trees[lang]:
            received = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                received = (*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4]))
            folded = leaf_of(received)
            for left, right in path + top:
                folded = digest(left, folded, right)
            yield row[0], leaf_of(row), sub, root, digest(*(a + b for a, b in path + top)), folded, folded == root


def odd_rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["web", None]), rng.choice(["en", "en", "de", "é", None]), rng.choice([None, i]), rng.choice(["Text A", "b", None, "", "É-Ü"])) for i in range(600)]
    rows += [(i, "s", "one", 1, "T") for i in range(1)] + [(i, "s", "nine", 1, "T") for i in range(9)] + [(i, "s", "sixtyfive", 1, "T") for i in range(65)]
    return [*rows, (None, "s", "en", 1, "ABC"), (None, "s", "en", 1, "ABC"), (7, "s", "en", 1, "X"), (7, "s", "en", 1, "Y"), (5, "s", "", 1, "a" * 50_000)]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest(spark, levels):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], SCHEMA).repartition(5)
    got = merkle.manifest(df, levels=levels)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))


def test_small_manifests(spark, no_docs):
    assert merkle.manifest(no_docs).count() == 0
    (one,) = merkle.manifest(spark.createDataFrame([(3, None, None, None, None, "", 0)], SCHEMA)).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == digest()


def test_tampering_is_found(spark):
    rows = [(i, "s", "en", 1, "Upper") for i in range(40)]
    for r in merkle.manifest(spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA)).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 3 != 0)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(merkle.ORACLE_SQL["op12_merkle_manifest"])
    got = merkle.op12_merkle_manifest(spark, sf)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
