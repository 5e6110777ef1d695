"""Masks as runs (tile, y, x0, x1, label): rasterising, overlaying, slicing, merging, components.

A run is a stretch of one row of a tile, x1 exclusive; background has no runs. A tile is bounded, so what belongs
to one may meet in one task; tiles are not, so everything is keyed by tile. Polygons are dealt by tile before they become runs,
so runs are made where they are needed and shuffled no more. Joins of runs are merge joins by hint: the planner takes a table for as small as the
one it was exploded from, and would send all runs through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import settled

RUN = ("y", "x0", "x1", "label")


def scanlines(polygons: DataFrame, rings: str = "rings", keys=("tile_id",), width: int = 1024, height: int = 1024) -> DataFrame:
    """``keys, obj, label, y, x0, x1``: the pixels whose centres are inside each polygon, by row.

    A row's centre line is crossed by edges by the half-open rule; crossings are sorted and taken in pairs, so holes
    come out by themselves.
    """
    edges = F.flatten(F.transform(F.col(rings), lambda ring: F.transform(F.slice(ring, F.lit(1), F.size(ring) - 1), lambda a, i: F.struct(
        a["x"].alias("xa"), a["y"].alias("ya"), F.get(ring, i + 1)["x"].alias("xb"), F.get(ring, i + 1)["y"].alias("yb")))))
    ys = F.flatten(F.transform(F.col(rings), lambda ring: F.transform(ring, lambda v: v["y"])))
    first = F.greatest(F.floor(F.array_min(ys)), F.lit(0)).cast("int")
    last = F.least(F.ceil(F.array_max(ys)), F.lit(height)).cast("int") - 1
    rows = polygons.repartition(*keys).select(*keys, "obj", "label", edges.alias("edges"), F.explode(F.when(first <= last, F.sequence(first, last))).alias("y"))
    line = F.col("y") + 0.5
    crossing = F.transform(
        F.filter("edges", lambda e: ((e["ya"] <= line) & (e["yb"] > line)) | ((e["yb"] <= line) & (e["ya"] > line))),
        lambda e: e["xa"] + (line - e["ya"]) * (e["xb"] - e["xa"]) / (e["yb"] - e["ya"]))
    return (
        rows.withColumn("cross", F.array_sort(crossing)).filter(F.size("cross") > 1)
        .select(*keys, "obj", "label", "y", F.posexplode("cross").alias("at", "xa"), "cross").filter(F.col("at") % 2 == 0)
        .select(*keys, "obj", "label", "y", F.greatest(F.ceil(F.col("xa") - 0.5), F.lit(0)).cast("int").alias("x0"),
                F.least(F.ceil(F.get("cross", F.col("at") + 1) - 0.5), F.lit(width)).cast("int").alias("x1"))
        .filter("x0 < x1")
    )


def overlay(runs: DataFrame, keys=("tile_id",), order: str = "obj") -> DataFrame:
    """Runs without overlap: where several cover a pixel, the one greatest by ``order`` shows. Touching equals are joined.

    Rows are cut at all starts and ends of runs; each piece takes its top cover, and neighbours of one label are joined. A row's runs number at most its width,
    so they meet as an array; rows of runs that are dealt by tile already are not shuffled.
    """
    found = runs.groupBy(*keys, "y").agg(F.collect_list(F.struct(F.col(order).alias("order"), "label", "x0", "x1")).alias("found"))
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda r: F.array(r["x0"], r["x1"])))))
    cover = lambda a: F.array_max(F.filter("found", lambda r: (r["x0"] <= a) & (r["x1"] > a)))
    tops = F.transform(F.transform(F.slice("cut", F.lit(1), F.size("cut") - 1), cover), lambda t: F.when(t.isNotNull(), F.struct(t["label"].alias("label"))))
    # A run starts and ends where the label beside it is another one.
    other = lambda top, i: top.isNotNull() & ~F.get("top", i).eqNullSafe(top)
    starts = F.transform("top", lambda top, i: F.when(other(top, i - 1), F.struct(F.get("cut", i).alias("x0"), top["label"].alias("label"))))
    stops = F.transform("top", lambda top, i: F.when(other(top, i + 1), F.get("cut", i + 1)))
    cut = found.withColumn("cut", ends).withColumn("top", tops)
    shown = cut.select(*keys, "y", F.inline(F.arrays_zip(F.array_compact(starts).alias("a"), F.array_compact(stops).alias("x1"))))
    return shown.select(*keys, "y", "a.x0", "x1", "a.label")


def coalesce_runs(runs: DataFrame, keys=("tile_id",)) -> DataFrame:
    """Touching runs of equal label made one."""
    order = Window.partitionBy(*keys, "y").orderBy("x0")
    starts = (F.lag("x1").over(order) == F.col("x0")) & (F.lag("label").over(order).eqNullSafe(F.col("label")))
    island = F.sum(F.when(starts, 0).otherwise(1)).over(order)
    return runs.withColumn("_i", island).groupBy(*keys, "y", "_i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("label").alias("label")).drop("_i")


def rasterize(polygons: DataFrame, rings: str = "rings", keys=("tile_id",), width: int = 1024, height: int = 1024) -> DataFrame:
    """The mask of labelled polygons: later ones (greater ``obj``) overwrite; un-classified becomes background."""
    return overlay(scanlines(polygons, rings, keys, width, height), keys).withColumn(
        "label", F.when(F.col("label") == 5, 0).otherwise(F.col("label"))).filter("label > 0")


def rectangle_runs(boxes: DataFrame, keys=("tile_id",)) -> DataFrame:
    """Runs of axis-parallel boxes, one for each row; quicker than scanlines where polygons are boxes."""
    return boxes.repartition(*keys).select(*keys, "obj", "label", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")


def slice_tiles(runs: DataFrame, n: int = 4, width: int = 1024, height: int = 1024, keys=("tile_id",)) -> DataFrame:
    """Runs cut into n x n patches, numbered by row from '000', with coordinates of their own."""
    if width % n or height % n:
        raise ValueError(f"{width} x {height} doesn't divide into {n} x {n} patches")
    pw, ph = width // n, height // n
    cut = runs.withColumn("_c", F.explode(F.sequence(F.expr(f"x0 div {pw}").cast("int"), F.expr(f"(x1 - 1) div {pw}").cast("int"))))
    return cut.select(
        *keys, F.lpad((F.expr(f"y div {ph}") * n + F.col("_c")).cast("string"), 3, "0").alias("patch_id"), F.expr(f"CAST(y % {ph} AS INT)").alias("y"),
        (F.greatest("x0", F.col("_c") * pw) - F.col("_c") * pw).alias("x0"), (F.least("x1", (F.col("_c") + 1) * pw) - F.col("_c") * pw).alias("x1"), "label")


def merge_patches(patches: DataFrame, n: int = 4, width: int = 1024, height: int = 1024, keys=("tile_id",)) -> DataFrame:
    """The inverse of ``slice_tiles``."""
    pw, ph = width // n, height // n
    index = F.col("patch_id").cast("int")
    dy, dx = F.floor(index / n).cast("int") * ph, index % n * pw
    return coalesce_runs(patches.select(*keys, (F.col("y") + dy).alias("y"), (F.col("x0") + dx).alias("x0"), (F.col("x1") + dx).alias("x1"), "label"), keys)


def connected_components(runs: DataFrame, keys=("tile_id",), side: int = 1024) -> DataFrame:
    """Add ``obj`` to runs: the 4-connected component, named by its first pixel (y * side + x). Labels don't part components.

    Connectivity is a property of one tile, whose runs are bounded by its size: one shuffle by tile, then tiles stream past, many in a batch, each
    whole. ``mosaic_components`` finds the same objects over tiles that touch.
    """
    keys = list(keys)
    fields = runs.select(*keys, "y", "x0", "x1", "label").schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "obj long"])
    names = [*keys, "y", "x0", "x1", "label"]
    return runs.select(*names).repartition(*keys).sortWithinPartitions(*keys, "y", "x0").mapInArrow(_components(keys, side), schema)


def _components(keys: list[str], side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            first = _tile_starts(table, keys)
            cut = int(first[-1])  # the last tile may go on in the next batch
            if cut:
                yield from _named(table.slice(0, cut), first[:-1], side)
            kept = table.slice(cut)
        if kept is not None and kept.num_rows:
            yield from _named(kept, _tile_starts(kept, keys), side)

    return run


def _tile_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a tile begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        values = table.column(k).combine_chunks()
        new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _named(table: pa.Table, first: np.ndarray, side: int) -> Iterator[pa.RecordBatch]:
    tile = np.zeros(table.num_rows, np.int64)
    tile[first[1:]] = 1
    y, x0, x1 = (table.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
    root = component_roots(np.cumsum(tile), y, x0, x1)
    obj = pa.chunked_array([pa.array(y[root] * side + x0[root], pa.int64())])
    yield from table.append_column("obj", obj).combine_chunks().to_batches()


def component_roots(tile: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The first run of each run's component; runs are in order of tile, row and column.

    All runs at once: neighbours are found by binary search, the smallest number spreads along them, and numbers jump to their number's number, until nothing changes.
    """
    wide, tall = int(x1.max(initial=0)) + 2, int(y.max(initial=0)) + 3
    row = (tile * tall + y) * wide
    n = np.arange(len(y))
    beside = np.flatnonzero((row[1:] == row[:-1]) & (x1[:-1] == x0[1:]))  # touching runs of one row
    low, high = np.searchsorted(row + x1, row + wide + x0, "right"), np.searchsorted(row + x0, row + wide + x1, "left")
    count = np.maximum(high - low, 0)
    a = np.repeat(n, count)
    b = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    a, b = np.concatenate([a, beside]), np.concatenate([b, beside + 1])
    root = n
    while len(a):
        least = root.copy()
        ra, rb = root[a], root[b]
        np.minimum.at(least, ra, rb)
        np.minimum.at(least, rb, ra)
        least = np.minimum(least, least[root])
        while (jumped := least[least] != least).any():
            least[jumped] = least[least[jumped]]
        if (least == root).all():
            break
        root = least
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def mosaic_components(runs: DataFrame, keys=(), side: int = 1024) -> DataFrame:
    """Components over a mosaic: ``runs`` has ``keys, col, row, y, x0, x1, label``, where (col, row) is a tile's place in its mosaic of tiles ``side`` wide and high.

    A building that crosses a border is one object. ``obj`` is the first pixel (y, x) of the component in the mosaic, as ``y * 2**31 + x``. A mosaic isn't bounded,
    so nothing meets by tile: runs are nodes, touching runs are edges of a table, and the smallest name spreads: each node takes the smallest name among its name's neighbours',
    and names jump to their name's name. A chain of n runs takes some log n rounds, each two joins by run; it ends when nothing changes. All joins merge: either side
    may hold a row for each run.
    """
    keys = list(keys)
    placed = runs.select("*", (F.col("row") * side + F.col("y")).cast("long").alias("_y"), (F.col("col") * side + F.col("x0")).cast("long").alias("_a"), (F.col("col") * side + F.col("x1")).cast("long").alias("_b"))
    name = F.col("_y") * (1 << 31) + F.col("_a")
    placed = settled(placed.withColumn("id", name))
    nodes = placed.select(*keys, "id", "_y", "_a", "_b")
    below = nodes.select(*keys, F.col("id").alias("other"), (F.col("_y") - 1).alias("_y"), F.col("_a").alias("c"), F.col("_b").alias("d"))
    # Within one row of a mosaic runs are joined by stretches of columns, so a wide row isn't one key.
    cell = lambda df, a, b: df.withColumn("_c", F.explode(F.sequence(F.floor(F.col(a) / side), F.floor((F.col(b) - 1) / side))))
    down = cell(nodes, "_a", "_b").join(cell(below, "c", "d").hint("merge"), [*keys, "_y", "_c"]).filter("_a < d AND c < _b").select(*keys, "id", "other")
    right = nodes.join(nodes.select(*keys, F.col("id").alias("other"), "_y", F.col("_a").alias("_b")).hint("merge"), [*keys, "_y", "_b"]).select(*keys, "id", "other")
    edges = down.unionByName(right).distinct()
    edges = settled(edges.unionByName(edges.select(*keys, F.col("other").alias("id"), F.col("id").alias("other"))))
    found = spread(edges, nodes.select(*keys, "id"), keys)[0]
    return placed.join(found.hint("merge"), [*keys, "id"]).drop("_y", "_a", "_b", "id").withColumnRenamed("name", "obj")


def spread(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``keys, id, name``: the smallest id that edges (``keys, id, other``, both ways) lead to; and the rounds it took. Only edges between different names go on to the next."""
    names = nodes.select(*keys, "id", F.col("id").alias("name"))
    links = edges.select(*keys, F.col("id").alias("a"), F.col("other").alias("b"))  # between names
    rounds = 0
    while True:
        # The smallest neighbour of each name; a name never takes a larger one, so following them ends at a root.
        hook = settled(links.groupBy(*keys, "a").agg(F.min("b").alias("to")).filter("to < a"))
        if hook.isEmpty():
            break
        while True:  # names of names: the way to each root is halved
            far = hook.select(*keys, F.col("a").alias("to"), F.col("to").alias("next"))
            jumped = settled(hook.join(far.hint("merge"), [*keys, "to"], "left").select(*keys, "a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            hook = jumped.drop("moved")
            if jumped.filter("moved").isEmpty():
                break
        at = lambda df, column: df.join(hook.select(*keys, F.col("a").alias(column), "to").hint("merge"), [*keys, column], "left").withColumn(column, F.coalesce("to", column)).drop("to")
        names = settled(at(names, "name"))
        links = settled(at(at(links, "a"), "b").filter("a <> b").distinct())
        rounds += 1
    return names, rounds


def pixel_pairs(gt: DataFrame, pd_: DataFrame, area: int, tiles: DataFrame, keys=("tile_id",)) -> DataFrame:
    """``keys, gt, pred, n``: pixels by true and predicted label, from runs; background counts as what is left of the tile."""
    row = [*keys, "y"]
    a = gt.select(*row, F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("label").alias("gt"))
    b = pd_.select(*row, F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("label").alias("pred"))
    width = F.least("a1", "b1") - F.greatest("a0", "b0")
    both = a.join(b.hint("merge"), row).filter((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1"))).groupBy(*keys, "gt", "pred").agg(F.sum(width).cast("long").alias("n"))
    in_gt = a.groupBy(*keys, "gt").agg(F.sum(F.col("a1") - F.col("a0")).cast("long").alias("n"))
    in_pd = b.groupBy(*keys, "pred").agg(F.sum(F.col("b1") - F.col("b0")).cast("long").alias("n"))
    zero = lambda name: F.lit(0).alias(name)
    only_gt = in_gt.select(*keys, "gt", zero("pred"), "n").unionByName(both.select(*keys, "gt", zero("pred"), (-F.col("n")).alias("n")))
    only_pd = in_pd.select(*keys, zero("gt"), "pred", "n").unionByName(both.select(*keys, zero("gt"), "pred", (-F.col("n")).alias("n")))
    seen = both.unionByName(only_gt).unionByName(only_pd).groupBy(*keys, "gt", "pred").agg(F.sum("n").alias("n"))
    rest = tiles.select(*keys).distinct().join(seen.groupBy(*keys).agg(F.sum("n").alias("_seen")).hint("merge"), list(keys), "left").select(
        *keys, zero("gt"), zero("pred"), (F.lit(area) - F.coalesce("_seen", F.lit(0))).cast("long").alias("n"))
    return seen.unionByName(rest).filter("n > 0")
