"""Confusion counts of a stream of pixels: the same grouped counts as in batch, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.lineage import settled
from tessera.operators.metrics import confusion_counts


def read_pixel_stream(spark: SparkSession, path: str, schema: str, max_files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start_confusion(pixels: DataFrame, name: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Counts by truth and prediction in the memory table ``name``; state is bounded by keys and classes."""
    return (
        confusion_counts(pixels, *keys).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_confusion(pixels: DataFrame, folder: str, checkpoint: str, *keys: str) -> StreamingQuery:
    """Counts by truth and prediction that outlive the query: what a batch changed is written below ``folder`` under the batch's number.

    Update mode: the state holds the counts, and each batch brings those that changed. A batch that is run again after a failure writes the same folder again, and a query that
    is started again goes on from its checkpoint, so every row counts once. See ``confusion_now``.
    """

    def sink(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/batch-{batch:012d}")

    return confusion_counts(pixels, *keys).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def confusion_now(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """What the batches in ``folder`` say: for each truth and prediction the count of the last batch that changed it."""
    found = spark.read.parquet(f"{folder}/batch-*")
    return settled(found).groupBy(*keys, "gt", "pred").agg(F.max_by("n", "batch").alias("n"))
