"""Cutting lineage where a result must not be computed twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder of ``spark.checkpoint.dir``, which all executors share.

    Only where that is unset and Spark runs on this machine alone, a temporary folder takes its place.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set for this application where it isn't yet."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def parts_for(df: DataFrame, rows_per_part: int = 500_000) -> int:
    """How many parts the rows of ``df``, a table as it is read, are dealt into, so that a task's share doesn't grow with the table. Counting such a table reads no columns."""
    total = df.count()
    usual = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (rows_per_part // 10)))
    return max(1, usual, -(-total // rows_per_part))


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``df`` in ``parts`` parts by ``key``. Up to ``spark.shuffle.sort.bypassMergeThreshold`` parts (200), a task writes rows straight to files; for more it would
    hold all rows of its split, so rows go into that many parts first, and a task deals on no more than one of those."""
    direct = int(df.sparkSession.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    if parts > direct:
        # By another name, or Spark takes both steps for one.
        df = df.withColumnRenamed(key, f"_{key}").repartition(direct, f"_{key}").withColumnRenamed(f"_{key}", key)
    return df.repartition(parts, key)
