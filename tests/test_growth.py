"""What must not grow with the input: broadcasts, shares of tasks, files; and the results of the steps that see to it."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera import views as V
from tessera.operators import balance as B
from tessera.operators import raster as R
from tessera.operators.lineage import parts_for, settled
from tessera.plans import queries as Q
from tessera.sources import rasters as I
from tessera.sources import tables as W


def plan(df, which="executedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


@pytest.mark.parametrize("name", ["mask_confusion_by_tile", "rasterized_courts", "rasterized_polygons", "damaged_and_empty", "coloured_rasters", "moved_rasters", "pasted_rasters"])
def test_nothing_that_grows_is_broadcast(name, spark, data_dir):
    """The tables are small here, so the planner would broadcast whatever it may."""
    assert "BroadcastHashJoin" not in plan(Q.QUERIES[name](spark, data_dir))


@pytest.mark.parametrize("name", ["greedy_order", "greedy_beginning"])
def test_the_greedy_order_is_merged(name, spark, data_dir):
    assert "rightHint=(strategy=merge)" in plan(Q.QUERIES[name](spark, data_dir), "optimizedPlan")


def test_overlay_is_the_painted_mask(spark):
    """Random rows: touching, nested, equal and empty runs, several labels, orders that aren't those of the rows."""
    rnd, rows = random.Random(3), []
    for y in range(200):
        for obj in rnd.sample(range(50), rnd.randrange(1, 9)):
            x0 = rnd.randrange(20)
            rows.append((y % 7, y, obj, rnd.randrange(1, 4), x0, x0 + rnd.randrange(6)))
    want = []
    for tile, y in {r[:2] for r in rows}:
        line = [None] * 30
        for _, _, _, label, x0, x1 in sorted(r for r in rows if r[:2] == (tile, y)):
            line[x0:x1] = [label] * (x1 - x0)
        x = 0
        while x < 30:
            end = x + 1
            while end < 30 and line[end] == line[x]:
                end += 1
            if line[x] is not None:
                want.append((tile, y, x, end, line[x]))
            x = end
    got = R.overlay(spark.createDataFrame(rows, "tile_id long, y int, obj long, label int, x0 int, x1 int"))
    assert sorted(map(tuple, got.select("tile_id", "y", "x0", "x1", "label").collect())) == sorted(want)


def test_parts_grow_with_rows(spark, data_dir):
    assert [parts_for(spark.range(n), 1000) for n in (0, 50, 250, 10_500)] == [1, 1, 3, 11]
    assert plan(Q.QUERIES["confusion_by_tile"](spark, data_dir)).count("Exchange") == 1


def test_blocks_of_clones_stay_apart(spark):
    now = spark.createDataFrame([("a", "destroyed", 1, 1, 100_000)], "dis_id string, label string, tile_id long, own long, deficit long")
    rest = spark.createDataFrame([("a", 1), ("a", 2)], "dis_id string, obj long")
    clones = B._clones(now, rest, 1, 0, 64)
    assert "REPARTITION_BY_NUM" in plan(clones) and clones.count() > 10_000


def test_patches_of_many_disasters_are_few_files(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 2).cast("string").alias("split"), F.concat(F.lit("d"), F.col("id") % 300).alias("dis_id"), F.lit("007").alias("tile_id"), F.lit("001").alias("patch_id"))
    W.write_patches(rows, str(tmp_path / "p"))
    assert len(list((tmp_path / "p").rglob("*.parquet"))) <= 8
    assert sorted(map(tuple, spark.read.schema("tile_id string, patch_id string, split string, dis_id string").parquet(str(tmp_path / "p")).select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))


def test_sums_of_rasters_of_several_shapes(spark):
    rows = [(1, 3, bytes(range(12))), (2, 1, bytes([5, 6])), (3, 3, bytes([255] * 12)), (4, 1, b""), (5, 3, bytes(range(6)))]
    rasters = spark.createDataFrame(rows, "k long, channels int, data binary").coalesce(1)
    want = []
    for k, n, data in rows:
        for c in range(n):
            v = list(data[c::n])
            if v:
                want.append((k, c, sum(v), sum(x * (i + 1) for i, x in enumerate(v))))
    found = I.placed_sums(rasters, "k")
    assert sorted(map(tuple, found.collect())) == sorted(want) and "Generate" not in plan(found)
    partials = {(r.k, r.channel): (r.n, r.s, r.q) for r in I.channel_partials(rasters, "k").collect()}
    assert partials[1, "G"] == (4, 22, 166) and partials[2, "M"] == (2, 11, 61) and partials[3, "R"] == (4, 1020, 4 * 255**2) and partials[4, "M"] == (0, 0, 0)


def test_mask_files_are_read_once(spark, data_dir):
    assert plan(Q.QUERIES["mask_files"](spark, data_dir)).lower().count("scan image") == 1


def test_replaced_buildings_are_not_dealt_by_disaster(spark, data_dir):
    """Only sums of donors, a row for each disaster, move by disaster alone."""
    lines = plan(Q.QUERIES["replacement_plan"](spark, data_dir)).splitlines()
    moved = [below for line, below in zip(lines, lines[1:]) if re.search(r"hashpartitioning\(dis_id#\d+, \d+\)", line)]
    assert moved and all("HashAggregate" in below and "partial_" in below for below in moved)


def test_orders_are_dealt_by_customer(spark, data_dir, monkeypatch):
    """In parts by number, which aren't put together into fewer as tables grow."""
    monkeypatch.setattr(V, "parts_for", lambda df: 7)
    lines = [line for line in plan(V.lines_of_tiles(spark, data_dir, "l_quantity")).splitlines() if "Exchange" in line]
    assert len(lines) == 4 and all(", 7), REPARTITION_BY_NUM" in line for line in lines)


@pytest.mark.parametrize("name", ["confusion_by_tile", "confusion_summed", "pixel_metrics_by_tile"])
def test_shares_of_counts_by_tile_are_bounded(name, spark, data_dir, monkeypatch):
    """Rows are dealt by tile into as many parts as there are rows for, before anything is counted; no task counts more than its part."""
    rows = V.pixels(spark, data_dir).count()
    monkeypatch.setattr(V, "parts_for", lambda df: parts_for(df, rows // 20))
    lines = [line for line in plan(Q.QUERIES[name](spark, data_dir)).splitlines() if "HashAggregate" in line or "Exchange" in line]
    dealt = [i for i, line in enumerate(lines) if re.search(r"hashpartitioning\(tile_id#\d+L, 2[01]\), REPARTITION_BY_NUM", line)]
    assert dealt == [len(lines) - 1] and sum("hashpartitioning(tile_id" in line for line in lines) == 1


@pytest.mark.parametrize("name", ["confusion_by_tile", "confusion_summed", "pixel_metrics_by_tile", "damaged_and_empty"])
def test_rows_for_many_parts_are_dealt_in_two_steps(name, spark, data_dir, monkeypatch):
    """No task deals a whole split into so many parts that it has to hold the rows; every row arrives once."""
    def rows(found):
        return sorted(map(tuple, found.collect()), key=repr)

    monkeypatch.setattr(V, "parts_for", lambda df: 6)
    want = rows(Q.QUERIES[name](spark, data_dir))
    monkeypatch.setattr(V, "parts_for", lambda df: 203)
    found = Q.QUERIES[name](spark, data_dir)
    lines = [line for line in plan(found).splitlines() if "REPARTITION_BY_NUM" in line or "Scan" in line]
    above = [line for line, below in zip(lines, lines[1:]) if "Scan" in below]
    assert above and all(", 200), REPARTITION_BY_NUM" in line for line in above)
    assert sum(", 203), REPARTITION_BY_NUM" in line for line in lines) == len(above) + (name == "damaged_and_empty")
    assert rows(found) == want


def test_runs_of_mosaics_are_merged_in_every_round(spark, data_dir, monkeypatch):
    """Each step is written before the next, so the plan of each is looked at, not that of the last alone."""
    plans = []
    monkeypatch.setattr(R, "settled", lambda df: plans.append(plan(df)) or settled(df))
    plans.append(plan(Q.QUERIES["mosaic_objects"](spark, data_dir)))
    assert len(plans) > 5 and sum("SortMergeJoin" in p for p in plans) >= 4 and not any("BroadcastHashJoin" in p for p in plans)


def sent_through_the_driver(text):
    """The lines of a plan below each broadcast."""
    found, above = [], []
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        above = [d for d in above if d < depth]
        if above:
            found.append(line)
        if "BroadcastExchange" in line:
            above.append(depth)
    return found


@pytest.mark.parametrize("name", ["balance_clones", "balance_classes"])
def test_clones_are_not_broadcast(name, spark, data_dir, monkeypatch):
    """Clones are made from a row for each disaster, so the planner takes them for few."""
    plans = []
    monkeypatch.setattr(B, "settled", lambda df: plans.append(plan(df)) or settled(df))
    plans.append(plan(Q.QUERIES[name](spark, data_dir)))
    assert any("clone#" in p for p in plans) and not [line for p in plans for line in sent_through_the_driver(p) if "clone#" in line]
    # Lines are read once for the totals, and once more for the buildings of the hosts.
    assert sum(len(re.findall(r"Scan parquet \[l_orderkey", p)) for p in plans) == (1 if name == "balance_clones" else 2)
    assert name == "balance_classes" or "BroadcastHashJoin" not in plans[-1]
