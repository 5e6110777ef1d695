"""Golden numbers, properties, plans, sources and streams."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import views
from tessera.functions import geometry as G
from tessera.operators import balance as slices
from tessera.operators import metrics as M
from tessera.operators import objects as O
from tessera.operators import raster as R
from tessera.operators import split as X
from tessera.operators import stats as T
from tessera.operators.ordering import _stretches, greedy_balance_order, with_group_position, with_position, with_prefix_sum
from tessera.plans import evaluate as E
from tessera.plans import prepare as P
from tessera.sources import catalog, labels, rasters, tables
from tessera.streaming.confusion import read_pixel_stream, start_confusion


@pytest.mark.parametrize(("f1", "want"), [
    ((0.9945, 0.6872, 0.3491, 0.4898, 0.7127), 0.5701), ((0.9944, 0.8005), 0.8870), ((0.9932, 0.6785, 0.3472, 0.5224, 0.7237), 0.5776), ((0.9930, 0.8030), 0.8880)])
def test_published_harmonic_means(spark, f1, want):
    # A confusion whose f1 is the given one: precision = recall = f1.
    rows = [(i, round(f * 10_000), 10_000 - round(f * 10_000), 10_000 - round(f * 10_000), 0) for i, f in enumerate(f1)]
    got = M.eval_metrics(spark.createDataFrame(rows, "class int, true_pos long, false_pos long, false_neg long, true_neg long")).first()
    assert abs(got.f1_harmonic_mean - want) < 1e-4


def test_object_metrics_of_the_golden_table(spark):
    rows = [(1, 510, 3306, 787, 0, 1297, 3816), (2, 39, 243, 920, 0, 959, 282), (3, 77, 477, 946, 0, 1023, 554), (4, 461, 1520, 789, 0, 1250, 1981)]
    df = spark.createDataFrame(rows, "class int, true_pos long, false_pos long, false_neg long, true_neg long, true_total long, pred_total long")
    for r, (_, tp, _, _, _, g, p) in zip(M.eval_metrics(df, style="object").orderBy("class").collect(), rows, strict=True):
        assert r.precision == tp / p and r.recall == tp / g and r.accuracy == tp / g
        assert abs(r.f1 - 2 * r.precision * r.recall / (r.precision + r.recall)) < 1e-12


def test_confusion_adds_up(spark, data_dir):
    px = views.pixels(spark, data_dir)
    n = px.count()
    for r in M.confusion_ovr(px).collect():
        assert r.true_pos + r.false_pos + r.false_neg + r.true_neg == r.total == n


def test_folds_and_sizes(spark):
    sizes = X.assign_folds(spark.range(13), 5, "id").groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in sizes] == [3, 3, 3, 2, 2]
    with pytest.raises(ValueError):
        X.assign_folds(spark.range(3), 1, "id")
    with pytest.raises(ValueError):
        X.split_sizes(10, {"a": 0.5, "b": 0.4})
    assert X.split_sizes(13, {"a": 0.8, "b": 0.1, "c": 0.1}) == {"a": 10, "b": 2, "c": 1}


def test_positions_and_prefix_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"))
    rows = with_prefix_sum(with_position(df, "v"), "pos", ["v"], block=64).orderBy("pos").collect()
    values = [r.v for r in rows]
    assert values == sorted(values) and [r.pos for r in rows] == list(range(1000))
    assert [r.v_upto for r in rows] == np.cumsum(values).tolist()


def test_positions_in_hot_groups(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "small").alias("g"), ((F.col("id") * 7919) % 3001).alias("v"))
    rows = with_group_position(df, ["g"], "v")
    for name, n in (("hot", 2400), ("small", 300), (None, 300)):
        own = sorted((r.pos, r.v, r["size"]) for r in rows.collect() if r.g == name)
        assert [p for p, _, _ in own] == list(range(n)) and [v for _, v, _ in own] == sorted(v for _, v, _ in own) and {s for _, _, s in own} == {n}


def test_strata_of_one_disaster(spark):
    # Nine tenths of all tiles are one stratum of one disaster.
    tiles = spark.range(2000).select(F.lit("d").alias("dis_id"), F.col("id").alias("tile_id"), *[(F.col("id") % 10 == 0).cast("long").alias(c) if c == "destroyed" else F.lit(1 if c == "no-damage" else 0).alias(c) for c in X.STRATA])
    found = X.split_stratified(tiles, {"train": 0.8, "val": 0.1, "test": 0.1}).groupBy("stratum", "split").count().collect()
    assert {(r.stratum, r.split): r["count"] for r in found} == {
        ("destroyed", "train"): 160, ("destroyed", "val"): 20, ("destroyed", "test"): 20, ("no-damage", "train"): 1440, ("no-damage", "val"): 180, ("no-damage", "test"): 180}


def test_greedy_order_can_stop_early(spark):
    tiles = spark.range(400).select(F.col("id").alias("tile_id"), *[(F.col("id") * k % 5).alias(c) for k, c in zip((3, 7, 11, 13), "abcd", strict=True)])
    whole = {r.tile_id: r.pos for r in greedy_balance_order(tiles, ["tile_id"], list("abcd")).collect()}
    first = {r.tile_id: r.pos for r in greedy_balance_order(tiles, ["tile_id"], list("abcd"), max_picks=25).collect()}
    assert sorted(whole.values()) == list(range(400)) and first == {t: p for t, p in whole.items() if p < 25}


def test_a_counter_of_16_bits_wraps(spark):
    runs = spark.createDataFrame([(1, 0, 0, 1, 0)], "tile_id int, y int, x0 int, x1 int, label int")
    assert T.pixel_counts(runs, 1024 * 1024).first().n_0 == 1 << 20
    assert T.pixel_counts(runs, 1024 * 1024, compat_uint16=True).first().n_0 == 0


def mask_of(runs, side):
    grid = np.zeros((side, side), int)
    for r in runs:
        grid[r.y, r.x0 : r.x1] = r.label
    return grid


def inside(ring, x, y):
    odd = False
    for (xa, ya), (xb, yb) in zip(ring, ring[1:], strict=False):
        if (ya <= y < yb) or (yb <= y < ya):
            odd ^= x <= xa + (y - ya) * (xb - xa) / (yb - ya)
    return odd


def test_rasterising_polygons_with_holes(spark):
    rng = random.Random(3)
    side, polys = 24, []
    for i in range(12):
        ring = [(rng.uniform(0, side), rng.uniform(0, side)) for _ in range(rng.randint(3, 7))]
        polys.append((0, i, 1 + i % 4, [ring + ring[:1]]))
    polys.append((0, 12, 3, [[(2, 2), (20, 2), (20, 20), (2, 20), (2, 2)], [(6, 6), (12, 6), (12, 12), (6, 12), (6, 6)]]))
    rows = [(t, o, l, "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings) + ")") for t, o, l, rings in polys]
    df = spark.createDataFrame(rows, "tile_id int, obj int, label int, wkt string").withColumn("rings", G.wkt_rings(F.col("wkt")))
    got = mask_of(R.rasterize(df, width=side, height=side).collect(), side)
    want = np.zeros((side, side), int)
    for _, _, label, rings in polys:
        for y in range(side):
            for x in range(side):
                if sum(inside(r, x + 0.5, y + 0.5) for r in rings) % 2:
                    want[y, x] = label
    assert (got == want).all()


def test_components_slices_and_merges(spark):
    rng = np.random.default_rng(4)
    side = 32
    grid = (rng.random((3, side, side)) < 0.6) * rng.integers(1, 5, (3, side, side))
    rows = [(t, y, x, x + 1, int(grid[t, y, x])) for t in range(3) for y in range(side) for x in range(side) if grid[t, y, x]]
    runs = R.coalesce_runs(spark.createDataFrame(rows, "tile_id int, y int, x0 int, x1 int, label int"))
    named = {}
    for r in R.connected_components(runs, side=side).collect():
        for x in range(r.x0, r.x1):
            named[r.tile_id, r.y, x] = r.obj
    seen = {}
    for t in range(3):
        for y in range(side):
            for x in range(side):
                if grid[t, y, x] and (t, y, x) not in seen:
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if (t, a, b) in seen or not (0 <= a < side and 0 <= b < side) or not grid[t, a, b]:
                            continue
                        seen[t, a, b] = y * side + x
                        todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert named == seen
    back = R.merge_patches(R.slice_tiles(runs, 4, side, side), 4, side, side)
    assert sorted(back.select("tile_id", "y", "x0", "x1", "label").collect()) == sorted(runs.select("tile_id", "y", "x0", "x1", "label").collect())
    with pytest.raises(ValueError):
        R.slice_tiles(runs, 5, side, side)


def test_the_matching_that_an_assignment_would_trade(spark):
    # g=[0,29), p=[9,38), g'=[30,38), p'=[0,8): the pair above one half is ambiguous.
    gt = spark.createDataFrame([(0, 0, 0, 29, 1, 1), (0, 0, 30, 38, 1, 2)], "tile_id int, y int, x0 int, x1 int, label int, obj long")
    pd = spark.createDataFrame([(0, 0, 9, 38, 1, 1), (0, 0, 0, 8, 1, 2)], "tile_id int, y int, x0 int, x1 int, label int, obj long")
    got = O.match_objects(O.object_iou(gt, pd)).collect()
    assert [(r.gid, r.pid, r.ambiguous) for r in got] == [(1, 1, True)]


def test_plans_hash_their_joins(spark, data_dir):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    boxes = views.polygons(spark, data_dir).selectExpr("tile_id", "obj", "x0 AS x1", "y0 AS y1", "x1 AS x2", "y1 AS y2")
    runs = R.rectangle_runs(views.polygons(spark, data_dir))
    for df in (O.bbox_join(boxes, boxes), O.overlap_pairs(runs, runs), M.eval_metrics(M.confusion_ovr(views.pixels(spark, data_dir), ["tile_id"]), ["tile_id"])):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_discount:double>" in plan(M.confusion_ovr(views.pixels(spark, data_dir)))


def test_label_files(spark, tmp_path):
    for phase, subtype in (("pre", {}), ("post", {"subtype": "destroyed"})):
        features = [{"wkt": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "properties": {"feature_type": "building", "uid": "u1", **subtype}}]
        (tmp_path / f"flood_00000001_{phase}_disaster.json").write_text(json.dumps({"features": {"xy": features}, "metadata": {}}, indent=1))
    rows = labels.read_labels(spark, str(tmp_path)).orderBy("phase").collect()
    assert [(r.dis_id, r.tile_id, r.phase, r.subtype, r.uid) for r in rows] == [("flood", "00000001", "post", "destroyed", "u1"), ("flood", "00000001", "pre", None, "u1")]
    assert labels.read_labels(spark, str(tmp_path), "post").count() == 1
    named, odd = catalog.tile_catalog(catalog.list_files(spark, str(tmp_path)))
    assert named.count() == 2 and odd.count() == 0 and catalog.check_catalog(named).count() == 1


def png(path, pixels):
    h, w, c = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_rasters(spark, tmp_path):
    rng = np.random.default_rng(1)
    image, mask = rng.integers(0, 256, (8, 6, 3), dtype=np.uint8), rng.integers(0, 3, (8, 6, 1), dtype=np.uint8)
    png(tmp_path / "flood_1_pre_disaster.png", image)
    png(tmp_path / "flood_1_post_disaster.png", mask)
    (tmp_path / "flood_2_pre_disaster.png").write_bytes(b"no image")
    rows = rasters.read_rasters(spark, str(tmp_path))
    assert rows.count() == 2 and [r.path.rsplit("/", 1)[1] for r in rasters.raster_rejects(spark, str(tmp_path)).collect()] == ["flood_2_pre_disaster.png"]
    stats = {r.channel: r for r in rasters.combine_partials(rasters.channel_partials(rows.filter("phase = 'pre'"), "dis_id", "tile_id"), "dis_id", "tile_id").collect()}
    for i, name in enumerate("RGB"):
        assert abs(stats[name]["mean"] - (image[:, :, i] / 255).mean()) < 1e-12 and abs(stats[name].stdv - (image[:, :, i] / 255).std()) < 1e-9
    runs = rasters.mask_runs(rows.filter("phase = 'post'"), "tile_id").collect()
    grid = np.zeros((8, 6), int)
    for r in runs:
        grid[r.y, r.x0 : r.x1] = r.label
    assert (grid == mask[:, :, 0]).all()


def test_augmentation(spark):
    grid = np.arange(64, dtype=np.uint8).reshape(8, 8, 1) % 5
    rows = spark.createDataFrame([("t", 8, 8, 1, bytearray(grid.tobytes()))], "raster_id string, height int, width int, channels int, data binary")
    still = dict(pad=0, angle=0.0, shift_x=0.0, shift_y=0.0, scale=1.0, flip_x=True, flip_y=False)
    params = rows.select("raster_id", *[F.lit(v).alias(k) for k, v in still.items()])
    turned = P.augment_geometry(rows, params, "raster_id").first()
    assert (np.frombuffer(turned.data, np.uint8).reshape(8, 8) == grid[:, ::-1, 0]).all()
    colours = P.augment_color(rows, P.augmentation_params(rows, "raster_id"), "raster_id").first()
    assert bytes(colours.data) == grid.tobytes()


def test_metric_files(spark, tmp_path):
    for conf, fold in ((0, 1), (12, 10)):
        folder = tmp_path / f"config-{conf}" / f"{conf}-fold_{fold}" / "metrics" / "csv"
        folder.mkdir(parents=True)
        (folder / "dmg.csv").write_text("epoch,f1_harmonic_mean,class,precision,recall,f1,accuracy\n1,0.5,0,0.5,0.5,0.5,0.5\n")
        (folder / "bare.csv").write_text("1,0.5,0,0.5,0.5,0.5,0.5\n2,0.5,0,0.5,0.5,0.5,0.5\n")
    assert sorted((r.conf, r.fold) for r in tables.read_metrics(spark, str(tmp_path), "dmg.csv").collect()) == [(0, 1), (12, 10)]
    assert tables.read_metrics(spark, str(tmp_path), "bare.csv", header=False).count() == 4


def test_writing_again_replaces_an_epoch(spark, tmp_path):
    rows = lambda e, v: spark.createDataFrame([("val", "pixel", e, v)], "split string, level string, epoch int, f1 double")
    path = str(tmp_path / "metrics")
    for e, v in ((1, 0.1), (2, 0.2), (1, 0.3)):
        tables.write_metrics(rows(e, v), path)
    assert sorted((r.epoch, r.f1) for r in spark.read.parquet(path).collect()) == [(1, 0.3), (2, 0.2)]
    splits = spark.createDataFrame([("train", "d", "007")], "split string, dis_id string, tile_id string")
    tables.write_splits(splits, str(tmp_path / "splits"))
    assert tables.read_splits(spark, str(tmp_path / "splits")).first().tile_id == "007"


def test_search_with_an_estimator_of_spark(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(120).select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 * 3.0).alias("x"))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    found = E.grid_search(df, lambda p, classes: LogisticRegression(weightCol="weight", **p), [{"maxIter": 5}, {"maxIter": 1, "threshold": 1.0}], 2, ["id"]).collect()
    assert sorted((r.conf, r.fold, r.chosen) for r in found) == [(0, 0, True), (0, 1, True), (1, 0, False), (1, 1, False)]
    assert all((r.hf1 > 0.99) == r.chosen for r in found)


def test_confusion_of_a_stream(spark, data_dir, tmp_path):
    px = views.pixels(spark, data_dir)
    px.repartition(4).write.parquet(str(tmp_path / "px"))
    q = start_confusion(read_pixel_stream(spark, str(tmp_path / "px"), "tile_id long, gt int, pred int", 1), "seen", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(spark.table("seen").collect()) == sorted(M.confusion_counts(px).collect())


def plain_choices(counts, copies, picks):
    """One vector at a time: the one that leaves the totals least imbalanced, the smaller one where equal."""
    left, totals, out = list(copies), [0] * len(counts[0]), []
    for _ in range(picks):
        def cost(i):
            after = [t + int(c) for t, c in zip(totals, counts[i], strict=True)]
            return len(after) * sum(a * a for a in after) - sum(after) ** 2, i

        best = min((i for i, n in enumerate(left) if n), key=cost)
        left[best] -= 1
        totals = [t + int(c) for t, c in zip(totals, counts[best], strict=True)]
        out.append(best)
    return out


def test_choices_that_repeat_are_taken_at_once():
    rng, turns = np.random.default_rng(5), 0
    for _ in range(60):
        counts = np.unique(rng.integers(0, rng.integers(2, 7), (rng.integers(1, 12), rng.integers(1, 5))), axis=0)
        copies = rng.integers(1, rng.choice([3, 40, 300]), len(counts))
        picks = int(copies.sum()) - int(rng.integers(0, 3)) * (len(counts) > 3)
        found = list(_stretches(counts, copies, picks, first=int(rng.choice([1, 4, 16])), most=64))
        assert [int(b) for chosen, times in found for _ in range(times) for b in chosen] == plain_choices(counts, copies, picks)
        turns += sum(times > 1 for _, times in found)
    assert turns > 60
    # Forty million picks of vectors that balance each other and of some that don't.
    counts, copies = np.array([[0, 1], [1, 0], [1, 1], [2, 0], [5, 0]]), np.array([10_000_003, 9_999_999, 10_000_000, 5_000_000, 5_000_000])
    found = list(_stretches(counts, copies, int(copies.sum())))
    assert sum(len(chosen) for chosen, _ in found) < 100_000 and sum(len(chosen) * times for chosen, times in found) == copies.sum()


def test_the_greedy_order_is_made_of_few_rows_in_many_tasks(spark):
    tiles = spark.range(60_000).select(F.concat(F.lit("g"), F.col("id") % 2).alias("g"), F.col("id").alias("tile_id"), (F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"))
    order = greedy_balance_order(tiles, ["tile_id"], ["a", "b"], ["g"])
    lines = order._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Generate explode" in line and "_times" in line for line in lines)
    rows = order.select("g", "a", "b", "tile_id", "pos").collect()
    for g in ("g0", "g1"):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in own] == list(range(30_000)) and len({r.tile_id for r in own}) == 30_000
        counts, copies = np.unique([(r.a, r.b) for r in own], axis=0, return_counts=True)
        want = [tuple(counts[b]) for b in plain_choices(counts, copies, 3000)]
        assert [(r.a, r.b) for r in own[:3000]] == want


def test_stretches_over_the_ends_of_blocks(spark):
    """Every stretch of rows once, wherever a block ends."""
    size = 65_536
    rows = spark.range(size + 900).select(F.col("id").alias("pos"), *[(F.col("id") * (i + 3) % (7 + i)).alias(c) for i, c in enumerate(slices.BUILDING_KEYS)])
    for n in (1, 2, 400, 65_900):
        found = {r.start: r.score for r in slices.slice_scores(rows, n, [0.0]).collect()}
        totals = np.array([[p * (i + 3) % (7 + i) for i in range(5)] for p in range(size + 900)]).sum(axis=1)
        upto = np.concatenate([[0], np.cumsum(totals)])
        sums = upto[n:] - upto[:-n]
        want = 100 * (sums - sums.min()) / max(sums.max() - sums.min(), 1)
        assert sorted(found) == list(range(len(sums))) and np.allclose([found[i] for i in range(len(sums))], want)
