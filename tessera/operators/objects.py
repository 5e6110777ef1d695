"""Objects: boxes, overlaps, one-to-one matching, object-level confusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Above this IoU a matched pair can't be outweighed by two weaker ones: (sqrt(17) - 3) / 2.
CERTAIN_IOU = (17**0.5 - 3) / 2


def object_table(runs: DataFrame, keys=("tile_id",)) -> DataFrame:
    """``keys, obj, label, area, x1, y1, x2, y2``: label by majority of pixels, the smallest of equal ones."""
    parts = runs.groupBy(*keys, "obj", "label").agg(
        F.sum(F.col("x1") - F.col("x0")).cast("long").alias("n"), F.min("x0").alias("x1"), F.min("y").alias("y1"), F.max("x1").alias("x2"), (F.max("y") + 1).alias("y2"))
    return parts.groupBy(*keys, "obj").agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"), F.sum("n").alias("area"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def overlap_pairs(gt_runs: DataFrame, pd_runs: DataFrame, keys=("tile_id",)) -> DataFrame:
    """``keys, gid, pid, inter``: shared pixels of true and predicted objects, by a join on tile and row."""
    row = [*keys, "y"]
    a = gt_runs.select(*row, F.col("obj").alias("gid"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = pd_runs.select(*row, F.col("obj").alias("pid"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    return a.join(b.hint("merge"), row).filter((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1"))).groupBy(*keys, "gid", "pid").agg(F.sum(shared).cast("long").alias("inter"))


def object_iou(gt_runs: DataFrame, pd_runs: DataFrame, keys=("tile_id",)) -> DataFrame:
    """Overlapping pairs with ``iou`` and both labels."""
    g = object_table(gt_runs, keys).select(*keys, F.col("obj").alias("gid"), F.col("label").alias("glabel"), F.col("area").alias("garea"))
    p = object_table(pd_runs, keys).select(*keys, F.col("obj").alias("pid"), F.col("label").alias("plabel"), F.col("area").alias("parea"))
    joined = overlap_pairs(gt_runs, pd_runs, keys).join(g.hint("merge"), [*keys, "gid"]).join(p.hint("merge"), [*keys, "pid"])
    iou = F.col("inter") / (F.col("garea") + F.col("parea") - F.col("inter"))
    return joined.select(*keys, "gid", "pid", "inter", iou.alias("iou"), "glabel", "plabel")


def match_objects(pairs: DataFrame, threshold: float = 0.5, keys=("tile_id",)) -> DataFrame:
    """One-to-one matches with ``iou > threshold``: ``keys, gid, pid, iou, glabel, plabel, ambiguous``.

    Objects of one side don't overlap, so above one half matches are one-to-one by themselves. Below, mutual best
    pairs are taken. ``ambiguous`` marks matches that an assignment by greatest sum could have traded for two weaker ones.
    """
    by_g, by_p = Window.partitionBy(*keys, "gid"), Window.partitionBy(*keys, "pid")
    marked = pairs.withColumn("ambiguous", (F.col("iou") <= CERTAIN_IOU) & (F.count("*").over(by_g) > 1) & (F.count("*").over(by_p) > 1))
    if threshold < 0.5:
        marked = (
            marked.withColumn("_g", F.row_number().over(by_g.orderBy(F.desc("iou"), "pid")))
            .withColumn("_p", F.row_number().over(by_p.orderBy(F.desc("iou"), "gid"))).filter("_g = 1 AND _p = 1")
        )
    return marked.filter(F.col("iou") > threshold).select(*keys, "gid", "pid", "iou", "glabel", "plabel", "ambiguous")


def unmatched(objects: DataFrame, matches: DataFrame, side: str, keys=("tile_id",)) -> DataFrame:
    """Objects without a match: ``side`` is ``gid`` (undetected) or ``pid`` (ghosts)."""
    return objects.select(*keys, F.col("obj").alias(side), "label").join(matches.select(*keys, side).hint("merge"), [*keys, side], "left_anti")


def object_confusion(gt: DataFrame, predicted: DataFrame, matches: DataFrame, keys=(), labels=range(1, 5)) -> DataFrame:
    """``keys, class, true_pos, false_pos, false_neg, true_neg, true_total, pred_total``."""
    rows = (
        gt.select(*keys, F.col("label").alias("class"), F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).alias("m"))
        .unionByName(predicted.select(*keys, F.col("label").alias("class"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("m")))
        .unionByName(matches.filter("glabel = plabel").select(*keys, F.col("glabel").alias("class"), F.lit(0).alias("g"), F.lit(0).alias("p"), F.lit(1).alias("m")))
    )
    sums = [F.struct(F.lit(c).alias("class"), *[F.sum(F.when(F.col("class") == c, F.col(x)).otherwise(0)).alias(x) for x in "gpm"]) for c in labels]
    return rows.groupBy(*keys).agg(F.array(*sums).alias("rows")).select(*keys, F.inline("rows")).select(
        *keys, "class", F.col("m").alias("true_pos"), (F.col("p") - F.col("m")).alias("false_pos"), (F.col("g") - F.col("m")).alias("false_neg"),
        F.lit(0).cast("long").alias("true_neg"), F.col("g").alias("true_total"), F.col("p").alias("pred_total"))


def object_confusion_matrix(gt: DataFrame, predicted: DataFrame, matches: DataFrame, labels=range(1, 5), keys=("tile_id",)) -> DataFrame:
    """Truth by row (and ``Ghost``, ``Total``), prediction by column (and undetected, total)."""
    cells = (
        matches.select(F.col("glabel").cast("string").alias("gt"), F.col("plabel").cast("string").alias("pred"))
        .unionByName(unmatched(gt, matches, "gid", keys).select(F.col("label").cast("string").alias("gt"), F.lit("Undetected").alias("pred")))
        .unionByName(unmatched(predicted, matches, "pid", keys).select(F.lit("Ghost").alias("gt"), F.col("label").cast("string").alias("pred")))
    )
    columns = [F.count_if(F.col("pred") == str(c)).alias(f"p{c}") for c in labels]
    return cells.rollup("gt").agg(*columns, F.count_if(F.col("pred") == "Undetected").alias("undetected"), F.count("*").alias("total")).withColumn(
        "gt", F.coalesce("gt", F.lit("Total")))


def bbox_join(a: DataFrame, b: DataFrame, cell: int = 64, keys=("tile_id",)) -> DataFrame:
    """Pairs of boxes (``obj, x1, y1, x2, y2``) that intersect, by a grid of cells; no pair is compared outside shared cells.

    A pair is reported by the cell of the lower corner of its intersection only, so it needs no distinct.
    """
    def dealt(df: DataFrame, mark: str) -> DataFrame:
        cells = lambda lo, hi: F.explode(F.sequence(F.expr(f"{lo} div {cell}"), F.expr(f"({hi} - 1) div {cell}")))
        named = df.filter("x1 < x2 AND y1 < y2").select(*keys, F.col("obj").alias(f"{mark}_obj"), *[F.col(c).alias(f"{mark}_{c}") for c in ("x1", "y1", "x2", "y2")])
        return named.withColumn("cx", cells(f"{mark}_x1", f"{mark}_x2")).withColumn("cy", cells(f"{mark}_y1", f"{mark}_y2"))

    joined = dealt(a, "a").join(dealt(b, "b"), [*keys, "cx", "cy"])
    meets = F.expr("a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2")
    here = (F.expr(f"greatest(a_x1, b_x1) div {cell}") == F.col("cx")) & (F.expr(f"greatest(a_y1, b_y1) div {cell}") == F.col("cy"))
    return joined.filter(meets & here).select(*keys, "a_obj", "b_obj")
