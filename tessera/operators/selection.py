"""Choosing configurations and reporting: best epochs, best configurations, curves, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.labels import label_key

RUN = ("conf", "fold")


def best_epochs(metrics: DataFrame, value: str = "hf1") -> DataFrame:
    """``conf, fold, epoch``: the first epoch with the greatest value."""
    return metrics.groupBy(*RUN).agg(F.max_by("epoch", F.struct(F.col(value), -F.col("epoch"))).alias("epoch"))


def fold_results(damage: DataFrame, buildings: DataFrame, losses: DataFrame) -> DataFrame:
    """``conf, fold, best_epoch, dmg_hf1, val_loss, seg_hf1`` at the best epoch by damage."""
    key = [*RUN, "epoch"]
    return (
        best_epochs(damage).join(damage.select(*key, F.col("hf1").alias("dmg_hf1")), key).join(losses.select(*key, F.col("loss").alias("val_loss")), key)
        .join(buildings.select(*key, F.col("hf1").alias("seg_hf1")), key)
        .select(*RUN, F.col("epoch").alias("best_epoch"), "dmg_hf1", "val_loss", "seg_hf1")
    )


def best_config(folds: DataFrame, by: str = "max", value: str = "dmg_hf1") -> DataFrame:
    """The configuration of the single best fold (``max``), or with the best mean over folds (``mean``); one row."""
    if by == "mean":
        folds = folds.groupBy("conf").agg(F.avg(value).alias(value), F.lit(0).alias("fold"))
    return folds.orderBy(F.desc(value), "conf", "fold").limit(1).select("conf")


def aligned_series(train: DataFrame, val: DataFrame, on: str = "epoch") -> DataFrame:
    """Training and validation values side by side; either may miss an epoch."""
    return train.select(on, F.col("value").alias("train")).join(val.select(on, F.col("value").alias("val")), on, "full")


def resumed(*runs: DataFrame) -> DataFrame:
    """Series of resumed runs put together; where epochs repeat, the later run counts."""
    out = None
    for i, run in enumerate(runs):
        tagged = run.withColumn("_run", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    last = Window.partitionBy("epoch").orderBy(F.desc("_run"))
    return out.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_run", "_rank")


def metric_curves(metrics: DataFrame, metric: str, classes=range(5)) -> DataFrame:
    """One row for each epoch, one column for each class key."""
    from tessera.functions.labels import KEYS

    named = metrics.select("epoch", label_key(F.col("class")).alias("key"), F.col(metric).alias("value"))
    return named.groupBy("epoch").pivot("key", [KEYS[c] for c in classes]).agg(F.first("value"))


def long_metrics(metrics: DataFrame, level: str, keys: list[str], values=("precision", "recall", "f1", "accuracy")) -> DataFrame:
    """``level, keys, class, metric, value``: one schema for the metrics of all levels."""
    return metrics.select(F.lit(level).alias("level"), *keys, F.col("class"), *values).unpivot(["level", *keys, "class"], list(values), "metric", "value")


def report_table(damage: DataFrame, buildings: DataFrame, split: str, digits: int = 4) -> DataFrame:
    """Segmentation rows (background from damage class 0, building from class 1 of the building table) over damage rows."""
    values = ("precision", "recall", "f1", "accuracy")
    rounded = [F.round(v, digits).alias(v) for v in values]
    seg = damage.filter("class = 0").select(F.lit("background").alias("name"), *rounded).unionByName(
        buildings.filter("class = 1").select(F.lit("building").alias("name"), *rounded))
    dmg = damage.select(label_key(F.col("class")).alias("name"), *rounded)
    return seg.withColumn("part", F.lit("seg")).unionByName(dmg.withColumn("part", F.lit("dmg"))).withColumn("split", F.lit(split))


def as_parameters(config: DataFrame, key: str = "conf_id") -> DataFrame:
    """A configuration as rows (parameter, value)."""
    names = [c for c in config.columns if c != key]
    return config.select(key, *[F.col(c).cast("string").alias(c) for c in names]).unpivot([key], names, "parameter", "value")
