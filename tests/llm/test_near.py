"""Near duplicates against exact similarities of all pairs."""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np

from tessera.llm import near_dedup as N
from tessera.llm.components import components
from tessera.llm.words import _LOWER, of_text
from tests.llm.conftest import TEXTS


def shingle_set(text: str | None) -> set:
    words = (text or "").encode().translate(bytes(_LOWER)).split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def result(spark, docs, **options) -> dict:
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, **options).collect()}


def test_families_chains_and_strangers(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    docs, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 30, 120, 300]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            docs.append((n * 7 % 1009, " ".join(copy)))
            n += 1
        base = list(base)
        for _ in range(6):  # a chain: each is near the one before only
            base[rng.randrange(len(base))] = f"x{n}"
            docs.append((n * 7 % 1009, " ".join(base)))
            n += 1
    assert result(spark, docs) == brute(docs)
    assert result(spark, docs, block=4) == brute(docs)


def test_hashes_tell_shingles_apart(spark, data_dir):
    for r in spark.read.parquet(f"{data_dir}/documents.parquet").limit(60).collect():
        assert len(N.shingles(of_text(r.text))) == len(shingle_set(r.text))


def test_edge_cases(spark, edge_docs, no_docs):
    rows = N.near_duplicates(edge_docs).collect()
    assert len(rows) == len(TEXTS)
    same = {r.doc_id: r.component_id for r in rows if r.doc_id in (5, 6)}
    assert same == {5: 5, 6: 5}
    assert [r.component_id for r in rows if r.doc_id is None] == [5]
    assert [r.n_shingles for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert all(r.component_id == r.doc_id for r in rows if r.doc_id in (1, 2, 3))
    assert N.near_duplicates(no_docs).count() == 0
    kept = N.drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]


def test_query_agrees_with_sql(spark, data_dir, same_rows):
    same_rows(N.op9_bayesian_near_dedup(spark, data_dir), N.ORACLES["op9_bayesian_near_dedup"])


def test_sequential_test_keeps_what_it_should():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (4000, 512), dtype=np.uint8)
    for similarity, least, most in ((0.86, 0.999, 1.0), (0.5, 0.0, 0.0)):
        b = np.where(rng.random(a.shape) < similarity, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
        assert least <= len(N.likely(a, b)) / len(a) <= most
    needed = N.least_matches(512, 32, 85, 1e-5)
    assert list(needed) == sorted(needed) and needed[0] < 32
    # The bound is the posterior's: one match fewer has a tail under the miss probability.
    t, n, m = 0.85 + 0.15 / 256, 32, needed[0] - 1
    assert sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1)) < 1e-5


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_a_text_of_50_mb():
    """Shingles of a long text are those of its parts, and take a bounded multiple of its distinct shingles."""
    import tracemalloc

    text = " ".join(f"w{i % 99_991}x{i % 7}" for i in range(5_700_000))[:50_000_000]
    raw = of_text(text)
    tracemalloc.start()
    found = N.shingles(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(raw) == 50_000_000 and 690_000 < len(found) < 710_000 and peak < 500_000_000
