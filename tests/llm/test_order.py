"""Shards, copies and mixtures against their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

from tessera.llm import exact_dedup, mixing, sharding
from tests.llm.conftest import TEXTS


def test_queries_agree_with_sql(spark, data_dir, same_rows):
    for module in (sharding, exact_dedup, mixing):
        for name, query in module.QUERIES.items():
            same_rows(query(spark, data_dir), module.ORACLES[name])


def test_shards_are_even_gapless_and_mixed(edge_docs, no_docs):
    rows = sharding.shard(edge_docs, shards=4).collect()
    assert len(rows) == len(TEXTS)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, i) for s, n in sizes.items() for i in range(n))
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in TEXTS)
    assert sorted((r.size, r.text_crc32) for r in rows) == want
    assert sharding.shard(no_docs).count() == 0


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "t", "big" if i % 10 else "small") for i in range(2000)]
    found = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=8).collect()
    for s in range(8):
        assert abs(sum(r.source == "small" for r in found if r.shard == s) - 25) <= 1


def test_cells_do_not_change_the_order(spark):
    docs = spark.createDataFrame([(i, i % 3, 1, 0) for i in range(500)], "doc_id long, source long, size long, crc long").cache()
    one = sharding.interleave(docs.withColumn("source", docs.source.cast("string")), rows_per_cell=10_000).collect()
    many = sharding.interleave(docs.withColumn("source", docs.source.cast("string")), rows_per_cell=2).collect()
    assert sorted(one) == sorted(many)


def test_exact_copies(edge_docs, no_docs):
    rows = exact_dedup.exact_dedup(edge_docs, support=0.3).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    sizes = Counter(norm(t) for _, t, *_ in TEXTS)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    assert len(rows) == len(TEXTS)
    assert all(r.group_size == sizes[sha[r.text_sha256]] for r in rows)
    assert Counter(sha[r.text_sha256] for r in rows if r.kept) == Counter(sizes.keys())
    group = [r for r in rows if sha[r.text_sha256] == "same text here"]
    assert {r.keep_id for r in group} == {5} and [r.doc_id for r in group if r.kept] == [5]
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_copies_with_repeated_and_null_ids(spark, tmp_path, same_rows):
    """The query agrees with its SQL where rows share text and id, and where ids are null."""
    rows = [(1, "a b"), (1, "a  b"), (1, "c"), (2, "a\tb"), (2, "c"), (3, None), (3, ""), (None, "a b"), (None, "d"), (None, "d")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = f"read_parquet('{tmp_path}/documents.parquet/*.parquet')"
    for name, query in exact_dedup.QUERIES.items():
        found = query(spark, str(tmp_path))
        same_rows(found, exact_dedup.ORACLES[name].replace("FROM documents", f"FROM {docs}"))
        assert [r.kept for r in found.collect() if r.doc_id == 1] == [True] * 3


def test_kept_documents_keep_their_columns(edge_docs):
    kept = exact_dedup.drop_exact_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8, 9, 10]


def test_heavy_and_light_paths_agree(spark):
    rows = [(i, f"text {i % 7 if i % 2 else 0}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(exact_dedup.exact_dedup(docs, support=0.2).collect()) == sorted(exact_dedup.exact_dedup(docs, support=0.9).collect())


def targets(sizes: dict, most: int = 3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_targets_stop_at_three_times_and_reshare(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 300}, {"a": 0, "b": 0}, {"x": 7}, {"a": 1, "b": 1, "c": 1, "d": 90, "e": 1, "f": 1000}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixture_spends_the_budget_and_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (5 + i * 7 % 23)), f"s{i % 10 % 7}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, slices=4).collect()
    total = sum(r.size for r in mixed)
    taken = sum(r.size * r.copies for r in mixed)
    assert total - 30 <= taken <= total and all(0 <= r.copies <= 3 for r in mixed)
    for s in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 60
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in mixed) == sorted((r.doc_id, r.copies) for r in again)


def test_mixture_edge_cases(edge_docs, no_docs):
    mixed = mixing.mix(edge_docs).collect()
    assert len(mixed) == len(TEXTS)
    assert sorted(r.size for r in mixed) == sorted(len((t or "").split()) for _, t, *_ in TEXTS)
    assert mixing.mix(no_docs).count() == 0
    whole = mixing.mixed_documents(edge_docs)
    assert whole.columns == edge_docs.columns and whole.count() == sum(r.copies for r in mixed)
    assert mixing.mixed_documents(no_docs).count() == 0
