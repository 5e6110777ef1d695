"""Rasters as Spark's image source reads them, and their pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.labels import file_key


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """``dis_id, tile_id, phase, height, width, channels, data``; colour bytes are in the order B, G, R. See ``raster_rejects``."""
    rows = _images(spark, path).filter("height > 0")
    dis, tile, phase = file_key(F.col("origin"))
    return rows.select(dis.alias("dis_id"), tile.alias("tile_id"), phase.alias("phase"), "height", "width", F.col("nChannels").alias("channels"), "data")


def raster_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files that hold no image that can be read."""
    return _images(spark, path).filter("height IS NULL OR height <= 0").select(F.col("origin").alias("path"))


def _images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")


def channel_partials(rasters: DataFrame, *keys: str) -> DataFrame:
    """``keys, channel, n, s, q``: count, sum and sum of squares of each raster's channels, for ``combine_partials``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, pixels in _alike(batch):
                channels = pixels.shape[2]
                names, v = ("BGR" if channels >= 3 else "M"), pixels.astype(np.int64)
                for i, name in enumerate(names):
                    of = v[:, :, i]
                    found = {"channel": [name] * len(rows), "n": [v.shape[1]] * len(rows), "s": of.sum(axis=1), "q": (of * of).sum(axis=1)}
                    yield _beside(batch.select(list(keys)).take(rows), found)

    return rasters.select(*keys, "channels", "data").mapInArrow(run, f"{fields}, channel string, n long, s long, q long")


def placed_sums(rasters: DataFrame, *keys: str) -> DataFrame:
    """``keys, channel, total, places``: the sum of each raster's channels, and the sum of values times their place, from 1."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, pixels in _alike(batch):
                place = np.arange(1, pixels.shape[1] + 1)
                for c in range(pixels.shape[2] if len(place) else 0):
                    of = pixels[:, :, c].astype(np.int64)
                    found = {"channel": pa.array([c] * len(rows), pa.int32()), "total": of.sum(axis=1), "places": of @ place}
                    yield _beside(batch.select(list(keys)).take(rows), found)

    return rasters.select(*keys, "channels", "data").mapInArrow(run, f"{fields}, channel int, total long, places long")


def _alike(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Rows of a batch whose rasters have one number of channels and of bytes, some megabytes at a time; and their pixels, (raster, place, channel)."""
    sizes, channels = pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False), batch.column("channels").to_numpy(zero_copy_only=False)
    for size, c in {(int(s), int(c)) for s, c in zip(sizes, channels, strict=True) if s >= 0}:
        rows, step = np.flatnonzero((sizes == size) & (channels == c)), max(1, most // max(size, 1))
        for at in range(0, len(rows), step):
            some = pa.array(rows[at : at + step])
            data = b"".join(v.as_buffer() for v in batch.column("data").take(some))
            yield some, np.frombuffer(data, np.uint8).reshape(len(some), size // c, c)


def _beside(rows: pa.RecordBatch, found: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(v) for v in found.values())], [*rows.schema.names, *found])


def combine_partials(partials: DataFrame, *keys: str) -> DataFrame:
    """Mean and population deviation of values scaled to [0, 1], from exact whole-number partials."""
    n, s, q = (F.sum(c).cast("double") for c in "nsq")
    mean = s / n / 255
    return partials.groupBy(*keys, "channel").agg(mean.alias("mean"), F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))).alias("stdv")).withColumn("stdv", F.col("stdv") / 255)


def read_mask_runs(spark: SparkSession, path: str) -> DataFrame:
    """``path, y, x0, x1, label``: the runs of the mask files below ``path``, and one row of -1 for each file that holds no image; files are listed and read once."""
    return mask_runs(_images(spark, path).select(F.col("origin").alias("path"), F.coalesce("height", F.lit(-1)).alias("height"), "width", F.col("nChannels").alias("channels"), "data"), "path")


def mask_runs(rasters: DataFrame, *keys: str) -> DataFrame:
    """``keys, y, x0, x1, label``: the runs of masks; of several channels the first counts, background has no runs. What has no height is a row of -1."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rasters.select(*keys).schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                if row.height <= 0:
                    yield pd.DataFrame({**{k: [getattr(row, k)] for k in keys}, **dict.fromkeys(("y", "x0", "x1", "label"), np.int32(-1))}, columns=[*keys, "y", "x0", "x1", "label"])
                    continue
                grid = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)[:, :, 0]
                edges = np.ones((row.height, row.width + 1), bool)
                edges[:, 1:-1] = grid[:, 1:] != grid[:, :-1]
                y, x = np.nonzero(edges)
                same = y[1:] == y[:-1]
                y0, x0, x1 = y[:-1][same], x[:-1][same], x[1:][same]
                label = grid[y0, x0]
                keep = label > 0
                yield pd.DataFrame({**{k: getattr(row, k) for k in keys}, "y": y0[keep].astype("int32"), "x0": x0[keep].astype("int32"),
                                    "x1": x1[keep].astype("int32"), "label": label[keep].astype("int32")}, columns=[*keys, "y", "x0", "x1", "label"])

    return rasters.select(*keys, "height", "width", "channels", "data").mapInPandas(run, f"{fields}, y int, x0 int, x1 int, label int")
