"""The operators' queries and their SQL, gathered for the entry point."""

from __future__ import annotations

from tessera.llm import (
    exact_dedup,
    language_id,
    mixing,
    multi_index_hashing,
    near_dedup,
    pii,
    prefix_trie,
    quality,
    secrets,
    sentence_pieces,
    sharding,
    structure_repair,
    url_filter,
)

_MODULES = (pii, secrets, sharding, sentence_pieces, multi_index_hashing, exact_dedup, url_filter, mixing, near_dedup, language_id, prefix_trie, structure_repair, quality)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
