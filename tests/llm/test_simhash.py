"""SimHash near-dedup against brute force."""

import numpy as np
import pytest
import xxhash

from shopledger.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius):
    """Per row the smallest id reachable; rows with a null id link nothing."""
    known = [k for k, i in enumerate(ids) if i is not None]
    group = {k: k for k in known}
    for a in known:
        for b in known:
            if (prints[a] ^ prints[b]).bit_count() <= radius and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    least = {}
    for k in known:
        least[group[k]] = min(least.get(group[k], ids[k]), ids[k])
    return [None if i is None else least[group[k]] for k, i in enumerate(ids)]


@pytest.mark.parametrize(("radius", "bucket"), [(2, 4096), (2, 1), (1, 2)])
def test_near_duplicates(docs, texts, no_docs, radius, bucket):
    prints = [brute_fingerprint(t) for _, t in texts]
    want = zip((i for i, _ in texts), (format(p, "016x") for p in prints), brute_components(prints, [i for i, _ in texts], radius), strict=True)
    got = simhash.near_duplicates(docs, radius=radius, bucket=bucket)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_repeated_ids_are_judged_by_their_own_text(spark):
    rows = [(7, "one two three four"), (7, "five six seven"), (3, "five six seven"), (9, None), (8, " \n"), (8, "ONE two three FOUR")]
    got = sorted((r.doc_id, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, False, 3), (7, False, 3), (7, False, 7), (8, False, 7), (8, True, 8), (9, True, 8)]


def test_radius_is_bounded(docs):
    with pytest.raises(ValueError, match="radius"):
        simhash.near_duplicates(docs, radius=3)


@pytest.mark.parametrize("radius", [1, 2])
def test_near_pairs(radius):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    one = np.uint64(1)
    values[600:1200] = values[:600] ^ (one << rng.integers(0, 64, 600).astype(np.uint64))
    values[1200:1400] = values[600:800] ^ (np.uint64(9) << rng.integers(0, 60, 200).astype(np.uint64))
    distance = np.bitwise_count(values[:, None] ^ values[None, :])
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(distance <= radius, 1))), strict=True))
    assert want and set(zip(*(x.tolist() for x in simhash.near_pairs(values, radius)), strict=True)) == want


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in docs]
    want = zip((r.doc_id for r in docs), (format(p, "016x") for p in prints), brute_components(prints, [r.doc_id for r in docs], 2), strict=True)
    assert sorted(map(tuple, simhash.op13_simhash(spark, sf).collect())) == sorted(want)
