"""Clones bring a class up to its disaster's largest, whatever the deficit."""

from __future__ import annotations

import hashlib

import pytest

from tessera.operators import balance as B
from tessera.plans import queries as Q

CLASSES = ("no-damage", "minor-damage", "major-damage", "destroyed")
EVERY = (*CLASSES, "un-classified")


def digest(*parts) -> str:
    return hashlib.md5(":".join(map(str, (0, *parts))).encode()).hexdigest()


def clones(tiles: list[tuple], minority: str) -> list[tuple]:
    """The definition: clone one tile that holds the class until the class is as large as the largest."""
    out, at = [], 2 + CLASSES.index(minority)
    for dis in sorted({t[0] for t in tiles}):
        own_tiles = [t for t in tiles if t[0] == dis]
        totals = [sum(t[2 + i] for t in own_tiles) for i in range(len(own_tiles[0]) - 2)]
        deficit, gained, clone = max(totals) - totals[at - 2], 0, 0
        holders = [t for t in own_tiles if t[at] > 0]
        if not holders:
            continue
        host = min(holders, key=lambda t: digest(dis, t[1]))
        while gained < deficit:
            clone += 1
            rate = (5 + int(digest("clone", dis, clone)[:8], 16) % 5) / 10
            gain = host[at] + round((sum(host[2:]) - host[at]) * rate)
            out.append((dis, clone, gain, gained, deficit, host[1]))
            gained += gain
    return out


#: Deficits over 10,000 and over a block of prefix sums, hosts without other classes, a tile that would gain nothing, no host.
TILES = [
    ("large", 1, 70_001, 0, 0, 0), ("large", 2, 0, 0, 0, 1),
    ("mixed", 1, 30_000, 5, 0, 0), ("mixed", 2, 3, 0, 1, 1), ("mixed", 3, 2, 0, 0, 0),
    *[("barren", i, 1, 0, 0, 0) for i in range(40)], ("barren", 99, 0, 0, 0, 1),
    ("none", 1, 7, 0, 0, 0), ("even", 1, 3, 3, 3, 3),
]


@pytest.mark.parametrize("options", [{}, {"block": 1000}])
def test_every_deficit_is_reached(spark, options):
    counts = spark.createDataFrame(TILES, "dis_id string, tile_id long, " + ", ".join(f"`{c}` long" for c in CLASSES))
    rows = B.balance_step(counts, "destroyed", **options).collect()
    assert sorted((r.dis_id, r.clone, r.gain, r.gained, r.deficit, r.tile_id) for r in rows) == clones(TILES, "destroyed")
    last = {r.dis_id: r.gained + r.gain - r.deficit for r in sorted(rows, key=lambda r: r.clone)}
    assert sorted(last) == ["barren", "large", "mixed"] and min(last.values()) >= 0


def test_query_is_the_definition(spark, data_dir):
    tiles = [(r.dis_id, r.tile_id, *(r[c] for c in EVERY)) for r in Q.counts(spark, data_dir).collect()]
    rows = Q.QUERIES["balance_clones"](spark, data_dir).collect()
    assert sorted((r.dis_id, r.clone, r.gain, r.gained, r.deficit, r.tile_id) for r in rows) == clones(tiles, "destroyed")


def test_classes_are_balanced_in_turn(spark):
    sizes = {"a": (700, 90, 40, 3, 0), "b": (5, 5, 5, 5, 2), "c": (12_000, 1, 0, 20, 3), "d": (9, 4, 2, 1, 60), "e": (9, 4, 2, 1, 5)}
    rows = [(d, i % 7 if c else i % 50, i * 5 + c, EVERY[c]) for d, ns in sizes.items() for c, n in enumerate(ns) for i in range(n)]
    buildings = spark.createDataFrame(rows, "dis_id string, tile_id long, obj long, label string")
    empty = {"e": 80}
    tiles = buildings.select("dis_id", "tile_id").unionByName(spark.createDataFrame([("e", 1000 + i) for i in range(empty["e"])], "dis_id string, tile_id long"))
    plan = B.balance_plan(buildings, block=500, tiles=tiles).collect()
    at = {}
    for d, t, o, c in rows:
        at.setdefault((d, t), []).append((o, c))
    for d, ns in sizes.items():
        first = dict(zip(EVERY, ns, strict=True))
        totals, target = dict(first), max(*ns, empty.get(d, 0))
        for place, label in enumerate(sorted((c for c in CLASSES if totals[c]), key=lambda c: (first[c], c)), 1):
            clones = sorted((r for r in plan if r.dis_id == d and r.label == label), key=lambda r: r.clone)
            assert (not clones) == (totals[label] >= target) and all(r.place == place for r in clones)
            for i, r in enumerate(clones, 1):
                host = at[d, r.tile_id]
                others = sorted((digest(i, o), o, c) for o, c in host if c != label)
                rate = (5 + int(digest("clone", d, label, i)[:8], 16) % 5) / 10
                assert (r.clone, r.replaced, r.gain) == (i, round(len(others) * rate), sum(c == label for _, c in host) + r.replaced)
                assert totals[label] < target
                totals[label] += r.gain
                for _, _, c in others[r.replaced :]:
                    totals[c] += 1
            assert totals[label] >= target
    assert not any(r.label == "un-classified" for r in plan)
