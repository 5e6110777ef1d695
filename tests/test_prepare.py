"""Stages that are made once, weights, cut and paste, mosaics, files."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import views
from tessera.functions import geometry as G
from tessera.operators import raster as R
from tessera.operators import stats as T
from tessera.plans import cutmix as U
from tessera.plans import prepare as P
from tessera.plans.queries import PREPARED
from tessera.plans.stages import Plan, Stage
from tessera.sources import files, labels, rasters
from tessera.streaming.confusion import confusion_now, read_pixel_stream, upsert_confusion


def test_a_second_preparation_makes_nothing(spark, data_dir, tmp_path):
    def plan(**changed):
        polys = views.with_wkt(views.polygons(spark, data_dir)).selectExpr(f"{views.DISASTER} AS dis_id", "*").withColumn("rings", G.wkt_rings(F.col("wkt")))
        tiles = views.tiles(spark, data_dir).selectExpr(f"{views.DISASTER} AS dis_id", "tile_id")
        return P.preparation(tiles, polys.drop("wkt"), views.channels(spark, data_dir), PREPARED | changed, f"file://{tmp_path}/prepared")

    first = plan()
    out = first.run()
    assert first.made == [s.name for s in first.stages]
    again = plan()
    again.run()
    assert again.made == []
    other = plan(props={"train": 0.6, "val": 0.2, "test": 0.2})
    other.run()
    assert other.made == ["splits", "clones", "augmented", "manifest", "weights", "configs"]
    grid = plan(grid={"lr": [0.1]})
    assert grid.run()["configs"].count() == 1 and grid.made == ["configs"]
    # Weights of both heads by hand, with the background of tiles without a building.
    side, tiles = 64, out["splits"].count()
    n = [0] * 6
    for r in out["masks"].collect():
        n[r.label] += r.x1 - r.x0
    n[0] = side * side * tiles - sum(n)
    got = {(r.head, r["class"]): r.weight for r in out["weights"].collect()}
    assert got == {("dmg", c): round(sum(n) / n[c], 2) if n[c] else 0.0 for c in range(5)} | {("seg", 0): round(sum(n[:5]) / n[0], 2), ("seg", 1): round(sum(n[:5]) / sum(n[1:5]), 2)}
    assert out["manifest"].count() == 16 * tiles and out["configs"].first().weights_dmg[0] == got["dmg", 0]
    (tmp_path / "prepared" / f"masks-{first.keys()['masks']}" / "_SUCCESS").unlink()  # as if it had been cut short
    cut = plan()
    cut.run()
    assert cut.made == ["masks"]


def test_a_sample_is_prepared_too(spark, tmp_path):
    rows = [(f"d{t % 2}", t, t * 10 + i, 1 + (t + i) % 4) for t in range(40) for i in range(t % 5)]
    polys = spark.createDataFrame(rows, "dis_id string, tile_id long, obj long, label int").withColumn(
        "rings", G.wkt_rings(F.concat(F.lit("POLYGON (("), *[x for p in ((0, 0), (3, 0), (3, 3), (0, 3), (0, 0)) for x in (F.lit(f"{p[0]} {p[1]}"), F.lit(", "))][:-1], F.lit("))"))))
    tiles = spark.createDataFrame([(f"d{t % 2}", t) for t in range(40)], "dis_id string, tile_id long")
    channels = spark.createDataFrame([(1, "pre", "R", 5)], "tile_id long, phase string, channel string, v int")
    params = PREPARED | {"strategy": "sample", "total": 20, "beta": 0.5, "width": 8, "height": 8, "n": 2}
    out = P.preparation(tiles, polys, channels, params, f"file://{tmp_path}/p").run()
    assert out["splits"].filter("draw = 0").count() == 16 and 0 < out["splits"].filter("draw > 0").count() <= 4
    assert out["manifest"].count() == 4 * out["splits"].count()


def test_stages_are_checked(spark, tmp_path):
    copy = lambda t, p: t["a"]
    with pytest.raises(ValueError, match="no earlier stage"):
        Plan(spark, str(tmp_path), {}, [Stage("b", ("a",), copy)])
    with pytest.raises(ValueError, match="twice"):
        Plan(spark, str(tmp_path), {"a": spark.range(1)}, [Stage("a", ("a",), copy)])
    keys = [Plan(spark, str(tmp_path), {"a": spark.createDataFrame(rows, "x int")}, [Stage("b", ("a",), copy)]).keys()["b"] for rows in ([(1,), (2,)], [(2,), (1,)], [(1,), (3,)])]
    assert keys[0] == keys[1] != keys[2]


def test_counts_of_tiles_without_runs(spark):
    runs = spark.createDataFrame([(1, 0, 0, 3, 2), (1, 1, 0, 4, 5), (9, 0, 0, 4, 1)], "tile_id int, y int, x0 int, x1 int, label int")
    tiles = spark.createDataFrame([(1,), (2,), (2,)], "tile_id int")
    assert sorted(tuple(r) for r in T.pixel_counts(runs, 16, tiles=tiles).collect()) == [(1, 9, 0, 3, 0, 0, 4), (2, 16, 0, 0, 0, 0, 0)]
    got = {(r.head, r["class"]): r.weight for r in T.weights_of_counts(T.pixel_counts(runs, 16, tiles=tiles)).collect()}
    assert got["dmg", 0] == round(32 / 25, 2) and got["dmg", 2] == round(32 / 3, 2) and got["dmg", 1] == 0 and got["seg", 0] == round(28 / 25, 2) and got["seg", 1] == round(28 / 3, 2)
    whole = spark.createDataFrame([(1, y, 0, 1024, 1) for y in range(0)], "tile_id int, y int, x0 int, x1 int, label int")
    assert T.pixel_counts(whole, 1024 * 1024, tiles=tiles.filter("tile_id = 1")).first().n_0 == 1 << 20
    assert T.pixel_counts(whole, 1024 * 1024, compat_uint16=True, tiles=tiles.filter("tile_id = 1")).first().n_0 == 0


def test_pastes_over_all_edges(spark):
    """Random polygons and places, three channels and a mask, several pastes in order, against a loop over pixels."""
    rnd, side = random.Random(7), 16
    rng = np.random.default_rng(7)
    image = {k: rng.integers(0, 256, (side, side, 3), dtype=np.uint8) for k in range(4)}
    mask = {k: rng.integers(0, 5, (side, side, 1), dtype=np.uint8) for k in range(4)}
    polys = {d: [(rnd.randrange(side + 4) - 2.0, rnd.randrange(side + 4) - 2.0) for _ in range(rnd.choice([3, 4, 5]))] for d in range(12)}
    polys = {d: [*p, p[0]] for d, p in polys.items()}
    places = [(k, s, str(rnd.randrange(12)), rnd.randrange(-8, 20), rnd.randrange(-8, 20), rnd.randrange(1, 12), rnd.randrange(1, 12), rnd.choice([0.0, 90.0, 180.0, -90.0, 33.0])) for k in range(4) for s in range(6)]
    rows = [(k, kind, side, side, a[k].shape[2], bytearray(a[k].tobytes()), "more") for kind, a in (("image", image), ("mask", mask)) for k in range(3)]
    hosts = spark.createDataFrame(rows, "raster_id long, kind string, height int, width int, channels int, data binary, note string").repartition(3)
    shapes = spark.createDataFrame([(d % 3, d, [[{"x": x, "y": y} for x, y in p]]) for d, p in polys.items()], "raster_id long, donor long, rings array<array<struct<x: double, y: double>>>")
    pieces = U.cut_outs(hosts, shapes)
    placed = spark.createDataFrame(places, "raster_id long, seq int, donor string, x int, y int, width int, height int, angle double")
    got = {(r.raster_id, r.kind): np.frombuffer(r.data, np.uint8).reshape(side, side, -1) for r in U.composite(hosts, placed, pieces).collect()}

    def under(p, y, x):
        inside = False
        for (xa, ya), (xb, yb) in zip(p, p[1:], strict=False):
            if (ya <= y + 0.5) != (yb <= y + 0.5):
                inside ^= xa + (y + 0.5 - ya) * (xb - xa) / (yb - ya) <= x + 0.5
        return inside

    for kind, source in (("image", image), ("mask", mask)):
        for k in range(3):
            want = source[k].copy()
            for _, _, donor, x0, y0, w, h, angle in [p for p in places if p[0] == k]:
                own = polys[int(donor)]
                at = [(y, x) for y in range(side) for x in range(side) if under(own, y, x)]
                if not at:
                    continue
                top, left = min(y for y, _ in at), min(x for _, x in at)
                ph, pw = max(y for y, _ in at) + 1 - top, max(x for _, x in at) + 1 - left
                c, s = np.cos(np.deg2rad(angle)), np.sin(np.deg2rad(angle))
                for y in range(max(y0, 0), min(y0 + h, side)):
                    for x in range(max(x0, 0), min(x0 + w, side)):
                        v, u = y - y0 - (h - 1) / 2, x - x0 - (w - 1) / 2
                        sy, sx = int(np.floor(c * v - s * u + h / 2 + 1e-9)), int(np.floor(s * v + c * u + w / 2 + 1e-9))
                        if 0 <= sy < h and 0 <= sx < w:
                            dy, dx = top + (2 * sy + 1) * ph // (2 * h), left + (2 * sx + 1) * pw // (2 * w)
                            if (dy, dx) in at and source[int(donor) % 3][dy, dx].any():
                                want[y, x] = source[int(donor) % 3][dy, dx]
            assert (got[k, kind] == want).all(), (k, kind)
    assert len(got) == 6


def test_what_hangs_over_is_cut_off():
    out = np.zeros((4, 16, 1), np.uint8)
    U.paste(out, np.arange(1, 7, dtype=np.uint8).reshape(1, 6, 1), 13, 1, 6, 1, 0.0)
    U.paste(out, np.arange(1, 7, dtype=np.uint8).reshape(1, 6, 1), -4, 2, 6, 1, 0.0)
    assert out[1, 12:, 0].tolist() == [0, 1, 2, 3] and out[2, :3, 0].tolist() == [5, 6, 0]


def test_placements(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in (*p, p[0])]
    rows = [(1, 1, "d", ring((0, 0), (4, 0), (4, 2), (0, 2)), ring((5, 5), (13, 5), (13, 9), (5, 9))), (2, 1, "d", ring((0, 0), (10, 0), (0, 1)), ring((3.7, 0), (3.7, 10), (2.7, 0)))]
    kind = "array<struct<x: double, y: double>>"
    got = {r.raster_id: r for r in U.placements(spark.createDataFrame(rows, f"raster_id int, seq int, donor string, donor_ring {kind}, host_ring {kind}")).collect()}
    assert (got[1].x, got[1].y, got[1].width, got[1].height, got[1].angle) == (5, 5, 8, 4, 0.0)
    assert (got[2].x, got[2].y, got[2].width, got[2].height) == (2, 0, 1, 10)


def test_snakes_and_mosaics(spark):
    # A snake that goes up and down 100 columns of 100 runs.
    name = lambda c, y: y * 1000 + 2 * c
    path = [name(c, y if c % 2 == 0 else 99 - y) for c in range(100) for y in range(100)]
    edges = spark.createDataFrame([(0, a, b) for x, y in zip(path, path[1:], strict=False) for a, b in ((x, y), (y, x))], "k int, id long, other long")
    names, rounds = R.spread(edges, spark.createDataFrame([(0, i) for i in path], "k int, id long"), ["k"])
    assert names.filter("name <> 0").count() == 0 and names.count() == 10_000 and rounds <= 3
    # Single tiles: the same objects as tile by tile; over tiles: those of one large tile.
    rng, side = np.random.default_rng(8), 16
    grid = rng.random((4 * side, 4 * side)) < 0.55
    cells = [(0, x // side, y // side, y % side, x % side, x % side + 1, 1 + (x + y) % 3) for y in range(4 * side) for x in range(4 * side) if grid[y, x]]
    runs = spark.createDataFrame(cells, "mosaic int, col int, row int, y int, x0 int, x1 int, label int")
    runs = R.coalesce_runs(runs, ["mosaic", "col", "row"])
    large = runs.selectExpr("mosaic", "row * 16 + y AS y", "col * 16 + x0 AS x0", "col * 16 + x1 AS x1", "label")
    pixels = lambda rows: sorted((r.y, r.x0 + i, r.obj) for r in rows for i in range(r.x1 - r.x0))
    whole = pixels(R.connected_components(large, ["mosaic"], 1 << 31).collect())
    found = R.mosaic_components(runs, ["mosaic"], side).selectExpr("row * 16 + y AS y", "col * 16 + x0 AS x0", "col * 16 + x1 AS x1", "obj").collect()
    assert pixels(found) == whole
    single = R.mosaic_components(runs.withColumns({"tile": F.col("row") * 4 + F.col("col")}).withColumns({"row": F.lit(0), "col": F.lit(0)}), ["mosaic", "tile"], side)
    apart = R.connected_components(runs.withColumn("tile", F.col("row") * 4 + F.col("col")), ["mosaic", "tile"], 1 << 31)
    key = lambda df: sorted((r.tile, r.y, r.x0, r.x1, r.label, r.obj) for r in df.collect())
    assert key(single) == key(apart)


def test_component_roots_in_small_batches(spark):
    rows = [(t, y, 2 * x, 2 * x + 1 + (y % 2), 1) for t in range(50) for y in range(7) for x in range(4)]
    runs = spark.createDataFrame(rows, "tile_id int, y int, x0 int, x1 int, label int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted(R.connected_components(runs, side=64).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        assert sorted(R.connected_components(runs, side=64).collect()) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert R.connected_components(runs.filter("1 = 0")).count() == 0


def test_files_of_rasters_and_labels(spark, tmp_path):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    rows = spark.createDataFrame([("d_1_pre_disaster.png", 5, 7, 3, bytearray(image.tobytes()))], "name string, height int, width int, channels int, data binary")
    pictures = files.as_png(rows, F.col("name")).unionByName(spark.createDataFrame([("d_2_pre_disaster.png", bytearray(b"no picture"))], "name string, content binary"))
    folder = f"file://{tmp_path}/pictures"
    assert files.write_files(pictures, folder) == 2 and files.write_files(pictures, folder) == 2
    assert sorted(p.name for p in (tmp_path / "pictures").iterdir()) == ["d_1_pre_disaster.png", "d_2_pre_disaster.png"]
    back = rasters.read_rasters(spark, folder).collect()
    assert len(back) == 1 and (np.frombuffer(back[0].data, np.uint8).reshape(5, 7, 3) == image[:, :, ::-1]).all()
    runs = spark.createDataFrame([(1, 2, 0, 3, 4), (1, 2, 5, 8, 1), (1, 0, 7, 8, 2)], "t int, y int, x0 int, x1 int, label int")
    drawn = files.masks_of_runs(runs, spark.createDataFrame([(1,), (2,)], "t int"), 8, 3, "t").orderBy("t").collect()
    assert [list(r.data) for r in drawn] == [[0] * 7 + [2] + [0] * 8 + [4, 4, 4, 0, 0, 1, 1, 1], [0] * 24]
    whole = '{"features": {"xy": [{"wkt": "P", "properties": {"feature_type": "building", "uid": "u"}}]}}'
    texts = {"a_1_post_disaster.json": whole, "a_2_post_disaster.json": whole[:-20], "a_3_post_disaster.json": "[1]", "a_4_post_disaster.json": "{}", "a_5_pre_disaster.json": "{"}
    folder = f"file://{tmp_path}/labels"
    files.write_files(spark.createDataFrame(list(texts.items()), "name string, content string"), folder)
    assert [(r.tile_id, r.uid) for r in labels.read_labels(spark, folder, "post").collect()] == [("1", "u")]
    assert sorted(r.path[-22:] for r in labels.label_rejects(spark, folder, "post").collect()) == [f"a_{i}_post_disaster.json" for i in (2, 3, 4)]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.range(300).selectExpr("id AS tile_id", "CAST(id % 3 AS INT) AS gt", "CAST(id % 5 AS INT) AS pred")
    seen = []
    for part in range(3):
        rows.filter(F.col("tile_id") % 3 == part).repartition(2).write.mode("append").parquet(f"{root}/px")
        stream = read_pixel_stream(spark, f"{root}/px", "tile_id long, gt int, pred int", 1)
        upsert_confusion(stream, f"{root}/counts", f"{root}/checkpoint").awaitTermination()
        seen.append(sum(r.n for r in confusion_now(spark, f"{root}/counts").collect()))
    assert seen == [100, 200, 300]
    assert sorted(tuple(r) for r in confusion_now(spark, f"{root}/counts").collect()) == sorted(tuple(r) for r in rows.groupBy("gt", "pred").count().collect())
