"""Every query against its SQL on the smallest tables; queries without SQL against their definition."""

from __future__ import annotations

import hashlib

import pytest

import __spark_entry__ as entry
from tessera.plans import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_agrees_with_sql(name, spark, data_dir, same_rows):
    same_rows(Q.QUERIES[name](spark, data_dir), Q.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def greedy(rows):
    """The definition: at each step the tile that leaves the totals least imbalanced."""
    left, totals, out = list(rows), [0] * 4, []
    while left:
        def cost(row):
            after = [t + c for t, c in zip(totals, row[1], strict=True)]
            return 4 * sum(a * a for a in after) - sum(after) ** 2, row[1], row[0]

        best = min(left, key=cost)
        left.remove(best)
        totals = [t + c for t, c in zip(totals, best[1], strict=True)]
        out.append(best[0])
    return out


def test_greedy_order_is_the_definition(spark, data_dir):
    counts = {}
    for r in Q.counts(spark, data_dir).collect():
        counts.setdefault(r.dis_id, []).append((r.tile_id, tuple(r[k] for k in Q.L.DAMAGE_KEYS)))
    found = {}
    for r in Q.QUERIES["greedy_order"](spark, data_dir).orderBy("dis_id", "pos").collect():
        found.setdefault(r.dis_id, []).append(r.tile_id)
    assert found == {d: greedy(rows) for d, rows in counts.items()}


def test_balanced_sample_is_the_definition(spark, data_dir):
    """The best stretch of the greedy order over all disasters, step by step; then every draw of empty tiles."""
    total, beta = 50, 0.7
    counts = Q.counts(spark, data_dir).collect()
    vectors = {(r.dis_id, r.tile_id): (tuple(r[k] for k in Q.L.DAMAGE_KEYS), sum(r[k] for k in Q.L.BUILDING_KEYS)) for r in counts}
    damaged, empty = {t: v for t, v in vectors.items() if sum(v[0])}, sorted(t for t, v in vectors.items() if not sum(v[0]))
    order = greedy([(t, v[0]) for t, v in damaged.items()])
    n_empty = int(total * 0.2)
    n = total - n_empty
    scores = []
    for start in range(len(order) - n + 1):
        chosen = [damaged[t] for t in order[start : start + n]]
        sums = [sum(v[0][i] for v in chosen) for i in range(4)]
        scores.append((sum(v[1] for v in chosen), 4 * sum(s * s for s in sums) - sum(sums) ** 2))
    spread = [(min(s[i] for s in scores), max(s[i] for s in scores)) for i in range(2)]
    scaled = [[(s[i] - lo) / (hi - lo) if hi > lo else 0.0 for i, (lo, hi) in enumerate(spread)] for s in scores]
    values = [round(100 * (1 - beta) * a - 100 * beta * b, 9) for a, b in scaled]
    start = values.index(max(values))
    want = [(d, t, "damaged", 0) for d, t in order[start : start + n]]
    for dis in {d for d, _ in order[start : start + n]}:
        pool = [t for d, t in empty if d == dis]
        for draw in range(1, round(sum(d == dis for d, _ in order[start : start + n]) * n_empty / n) + 1):
            if pool:
                want.append((dis, pool[int(hashlib.md5(f"0:{dis}:{draw}".encode()).hexdigest()[:8], 16) % len(pool)], "empty", draw))
    got = [(r.dis_id, r.tile_id, r.kind, r.draw) for r in Q.B.balanced_sample(Q.counts(spark, data_dir), total, beta).collect()]
    assert sorted(got) == sorted(want) and sum(k == "empty" for _, _, k, _ in got) > 0
