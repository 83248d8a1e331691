"""The queries of this package and their SQL twins."""

from __future__ import annotations

from . import (
    alignment,
    byte_bpe,
    jaccard_join,
    line_dedup,
    merkle,
    packing,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    vector_search,
    warc,
)

MODULES = (token_counts, jaccard_join, vector_search, quality_rules, packing, warc, sharding, substring_dedup, byte_bpe, line_dedup, alignment, merkle, simhash)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
