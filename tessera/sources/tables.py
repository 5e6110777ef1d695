"""Sinks and sources of splits, patches and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_SCHEMA = "epoch int, f1_harmonic_mean double, class int, precision double, recall double, f1 double, accuracy double"
LOSS_SCHEMA = "epoch int, loss double"


def write_splits(splits: DataFrame, path: str) -> None:
    splits.write.mode("overwrite").partitionBy("split").parquet(path)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_patches(patches: DataFrame, path: str) -> None:
    """Patches by split, in each the disasters in order, so that files hold ranges of them and a reader of one skips the others; ids keep their leading zeros as strings.

    A folder for each disaster would be as many files as there are disasters, moved one by one when they are committed.
    """
    patches.repartitionByRange("split", "dis_id", "tile_id").sortWithinPartitions("split", "dis_id", "tile_id").write.mode("overwrite").partitionBy("split").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics by split, level and epoch. Writing an epoch again replaces it and nothing else."""
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "level", "epoch").parquet(path)


def read_metrics(spark: SparkSession, root: str, name: str, schema: str = METRIC_SCHEMA, header: bool = True) -> DataFrame:
    """The CSV files ``name`` of all configurations and folds, with ``conf`` and ``fold`` from the path.

    ``header=False`` reads files that lost their header; the schema is given, never inferred.
    """
    rows = spark.read.schema(schema).option("header", header).csv(f"{root}/config-*/*-fold_*/metrics/csv/{name}")
    path = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(path, r"config-([0-9]+)/", 1).cast("int").alias("conf"), F.regexp_extract(path, r"-fold_([0-9]+)/", 1).cast("int").alias("fold"))
