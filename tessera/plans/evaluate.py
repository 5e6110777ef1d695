"""From masks to metrics: pixel and object evaluation of predictions, scoring, search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import settled
from tessera.operators.metrics import confusion_ovr, eval_metrics
from tessera.operators.objects import match_objects, object_confusion, object_iou, object_table
from tessera.operators.raster import connected_components, pixel_pairs
from tessera.operators.selection import best_config


def score(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Predictions in Arrow batches. ``make_model`` runs once in each Python worker and returns what maps a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            yield model(batch)

    return df.mapInPandas(run, schema)


def pixel_confusion(gt: DataFrame, predicted: DataFrame, area: int, tiles: DataFrame, keys=("tile_id",), labels=range(5)) -> DataFrame:
    """One-against-rest confusion by tile from masks of runs."""
    pairs = pixel_pairs(gt, predicted, area, tiles, keys)
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    rows = [F.struct(
        F.lit(c).alias("class"), of((F.col("gt") == c) & (F.col("pred") == c)).alias("true_pos"), of((F.col("gt") != c) & (F.col("pred") == c)).alias("false_pos"),
        of((F.col("gt") == c) & (F.col("pred") != c)).alias("false_neg"), of((F.col("gt") != c) & (F.col("pred") != c)).alias("true_neg"), F.sum("n").alias("total"),
    ) for c in labels]
    return pairs.groupBy(*keys).agg(F.array(*rows).alias("rows")).select(*keys, F.inline("rows"))


def evaluate(gt: DataFrame, predicted: DataFrame, side: int, tiles: DataFrame, keys=("tile_id",), threshold: float = 0.5) -> dict[str, DataFrame]:
    """Pixel and object confusion by tile, and metrics over all tiles, for masks of runs.

    Components are found once for each mask and settled, since matching and counting both read them.
    """
    keys = list(keys)
    by_tile = pixel_confusion(gt, predicted, side * side, tiles, keys)
    gt_objects, pd_objects = (settled(connected_components(m, keys, side)) for m in (gt, predicted))
    g, p = object_table(gt_objects, keys), object_table(pd_objects, keys)
    matches = match_objects(object_iou(gt_objects, pd_objects, keys), threshold, keys)
    objects_by_tile = object_confusion(g, p, matches, keys)
    sums = lambda df, cs: df.groupBy("class").agg(*[F.sum(c).alias(c) for c in cs])
    counts = ["true_pos", "false_pos", "false_neg", "true_neg"]
    return {
        "pixel_by_tile": by_tile,
        "object_by_tile": objects_by_tile,
        "matches": matches,
        "pixel": eval_metrics(sums(by_tile, [*counts, "total"])),
        "object": eval_metrics(sums(objects_by_tile, [*counts, "true_total", "pred_total"]), style="object"),
    }


class CentredLogits:
    """A classifier in closed form: the class whose logit exceeds its weighted mean over the training rows the most.

    ``scale`` says how much of the mean is taken off. Rows have ``logits``, a number for each class, and ``weight``.
    """

    def __init__(self, classes: list[int], scale: float = 1.0):
        self.classes, self.scale = classes, scale

    def fit(self, rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        means = rows.agg(*[F.try_divide(F.sum(F.get("logits", F.lit(i)) * F.col("weight")), F.sum("weight")) for i in range(len(self.classes))]).first()
        centred = F.array(*[F.get("logits", F.lit(i)) - self.scale * (m or 0.0) for i, m in enumerate(means)])
        return lambda df: df.withColumn("prediction", F.get(F.array(*map(F.lit, self.classes)), (F.array_position(centred, F.array_max(centred)) - 1).cast("int")))


def grid_search(df: DataFrame, estimator, grid: list[dict], k: int, keys: list[str], label: str = "label", seed: int = 0, at_once: int = 4, weighted: bool = True) -> DataFrame:
    """Cross-validated search: ``conf, fold, hf1, chosen``, scored by the harmonic mean of f1 over the classes; ``chosen`` marks the configuration of the best fold.

    ``estimator(params, classes).fit(rows)`` returns a model (or a function) that adds ``prediction``. Rows carry ``weight``: the class weights of the fold's own training rows, so nothing of the
    held-out rows is in them. Folds and classes are settled once. ``at_once`` fits run side by side, each of them distributed; a configuration and fold leaves one row.
    """
    from tessera.operators.split import assign_folds

    folds = settled(assign_folds(df, k, *keys, seed=seed))
    classes = sorted(r[0] for r in folds.select(F.col(label).cast("int")).distinct().collect())

    def train(fold: int) -> DataFrame:
        rows = folds.filter(F.col("fold") != fold)
        if not weighted:
            return rows.withColumn("weight", F.lit(1.0))
        counts = {r[0]: r[1] for r in rows.groupBy(F.col(label).cast("int")).count().collect()}
        weight = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, round(sum(counts.values()) / n, 2))])
        return rows.withColumn("weight", weight[F.col(label).cast("int")])

    trains = [train(fold) for fold in range(k)]

    def one(task: tuple[int, int]) -> tuple[int, int, float]:
        conf, fold = task
        model = estimator(grid[conf], classes).fit(trains[fold])
        seen = (model if callable(model) else model.transform)(folds.filter(F.col("fold") == fold)).select(F.col(label).cast("int").alias("gt"), F.col("prediction").cast("int").alias("pred"))
        return conf, fold, eval_metrics(confusion_ovr(seen, labels=classes)).agg(F.first("f1_harmonic_mean")).first()[0]

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(df.sparkSession)(one), [(c, f) for c in range(len(grid)) for f in range(k)]))
    found = df.sparkSession.createDataFrame(rows, "conf int, fold int, hf1 double")
    return found.join(F.broadcast(best_config(found, value="hf1").select(F.col("conf").alias("_best"))), how="cross").withColumn("chosen", F.col("conf") == F.col("_best")).drop("_best")
