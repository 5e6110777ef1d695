"""Counts and statistics of tiles, classes and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.labels import BUILDING_KEYS, DAMAGE_KEYS, KEYS


def count_by_class(buildings: DataFrame, catalog: DataFrame | None = None, keys=("dis_id", "tile_id"), labels=BUILDING_KEYS) -> DataFrame:
    """Buildings by tile and class, a column for each class; tiles of ``catalog`` without buildings count zeros."""
    counts = buildings.groupBy(*keys).agg(*[F.count_if(F.col("label") == k).alias(k) for k in labels])
    if catalog is not None:
        counts = catalog.select(*keys).distinct().join(counts, list(keys), "left").fillna(0)
    return counts


def pixel_counts(runs: DataFrame, area: int, compat_uint16: bool = False, keys=("tile_id",), labels=range(6), tiles: DataFrame | None = None) -> DataFrame:
    """Pixels by tile and class from runs; what no run covers is background. ``compat_uint16`` wraps as 16-bit counters do.

    Runs are added up as they are, without a row for each pixel. With ``tiles``, a table of ``keys``, all its tiles are counted, once each: those without a
    run are background, and runs of other tiles don't count.
    """
    width = F.col("x1") - F.col("x0")
    out = runs.groupBy(*keys).agg(*[F.sum(F.when(F.col("label") == c, width).otherwise(0)).cast("long").alias(f"n_{c}") for c in labels if c])
    if tiles is not None:
        out = tiles.select(*keys).distinct().join(out, list(keys), "left").fillna(0, [f"n_{c}" for c in labels if c])
    covered = sum((F.col(f"n_{c}") for c in labels if c), F.lit(0))
    out = out.select(*keys, (F.lit(area) - covered).cast("long").alias("n_0"), *[f"n_{c}" for c in labels if c])
    return out.withColumns({f"n_{c}": F.pmod(F.col(f"n_{c}"), F.lit(65536)) for c in labels}) if compat_uint16 else out


def class_weights(pixels: DataFrame, label: str = "gt", digits: int | None = 2) -> DataFrame:
    """``head, class, weight``: total / count by class for damage (0 where there is none), background against buildings for segmentation."""
    counts = pixels.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return _weights(counts.agg(F.sum("n").alias("total"), *[F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in range(5)]), digits)


def weights_of_counts(counts: DataFrame, digits: int | None = 2, labels=range(6)) -> DataFrame:
    """The same from counts by tile (``n_0`` to ``n_5``): un-classified pixels are in the total, and have no weight."""
    sums = {c: F.coalesce(F.sum(f"n_{c}"), F.lit(0)).cast("long") for c in labels}
    return _weights(counts.agg(*[v.alias(f"c{c}") for c, v in sums.items()]).withColumn("total", sum((F.col(f"c{c}") for c in labels), F.lit(0))), digits)


def _weights(one: DataFrame, digits: int | None) -> DataFrame:
    """From one row of ``total`` and ``c0`` to ``c4``."""
    built = sum((F.col(f"c{c}") for c in range(1, 5)), F.lit(0))
    rounded = lambda w: F.round(w, digits) if digits is not None else w
    rows = [F.struct(F.lit("dmg").alias("head"), F.lit(c).alias("class"),
                     rounded(F.coalesce(F.try_divide(F.col("total"), F.col(f"c{c}")), F.lit(0.0))).alias("weight")) for c in range(5)]
    rows += [F.struct(F.lit("seg").alias("head"), F.lit(c).alias("class"), rounded(F.try_divide(F.col("c0") + built, n)).alias("weight"))
             for c, n in enumerate((F.col("c0"), built))]
    return one.select(F.inline(F.array(*rows)))


def channel_stats(channels: DataFrame, keys=("tile_id", "phase", "channel"), ddof: int = 0) -> DataFrame:
    """Mean and deviation of values scaled to [0, 1], by tile, phase and channel."""
    scaled = F.col("v") / 255
    return channels.groupBy(*keys).agg(F.avg(scaled).alias("mean"), (F.stddev_pop if ddof == 0 else F.stddev_samp)(scaled).alias("stdv"))


def split_by_presence(counts: DataFrame, labels=DAMAGE_KEYS) -> tuple[DataFrame, DataFrame]:
    """Tiles with buildings of the damage classes, and tiles without."""
    return counts.filter(presence(labels) == "damaged"), counts.filter(presence(labels) == "empty")


def presence(labels=DAMAGE_KEYS) -> Column:
    """``damaged`` for tiles with buildings of the damage classes, ``empty`` for the others."""
    return F.when(sum((F.col(f"`{k}`") for k in labels), F.lit(0)) > 0, "damaged").otherwise("empty")


def class_totals(buildings: DataFrame) -> DataFrame:
    """Buildings by disaster and class with subtotals; null marks a subtotal's rolled-up column."""
    return buildings.filter(F.col("label").isNotNull()).rollup("dis_id", "label").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def tiles_by_group(tiles: DataFrame, *group: str) -> DataFrame:
    return tiles.rollup(*group).agg(F.count_distinct("tile_id").alias("tiles"))


def level_counts(objects: DataFrame, label: str = "label") -> DataFrame:
    """Objects of each damage level 1 to 4 by tile, zeros included."""
    levels = [F.struct(F.lit(c).alias("level"), F.count_if(F.col(label) == c).alias("n")) for c in range(1, 5)]
    return objects.groupBy("tile_id").agg(F.array(*levels).alias("levels")).select("tile_id", F.inline("levels")).withColumn("key", F.element_at(F.array(*map(F.lit, KEYS)), F.col("level") + 1))


def histogram(df: DataFrame, columns: list[str], bins: int = 20) -> DataFrame:
    """``name, bin, n``: equal bins between each column's least and greatest value, which is in the last bin."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])))
    ends = long.groupBy("name").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    place = F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)) * bins)
    return long.join(F.broadcast(ends), "name").groupBy("name", F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def imbalance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance over class counts, by row."""
    n = len(columns)
    total = sum((F.col(f"`{c}`") for c in columns), F.lit(0))
    squares = sum((F.col(f"`{c}`") * F.col(f"`{c}`") for c in columns), F.lit(0))
    return df.withColumn("imbalance", (n * squares - total * total).cast("double") / (n * n))


def totals_desc(counts: DataFrame, columns: list[str], key: str = "dis_id") -> DataFrame:
    """Totals by disaster, the largest first."""
    return counts.groupBy(key).agg(*[F.sum(f"`{c}`").alias(c) for c in columns]).withColumn(
        "total", sum((F.col(f"`{c}`") for c in columns), F.lit(0))).orderBy(F.desc("total"), key)


def min_max(column: Column, window: Window | None = None) -> Column:
    """Scaled to [0, 1] over a window; null where all values are equal."""
    over = (lambda c: c.over(window)) if window is not None else (lambda c: c)
    low, high = over(F.min(column)), over(F.max(column))
    return F.try_divide(column - low, high - low)


def shape_violations(rasters: DataFrame) -> DataFrame:
    """Tiles whose rasters differ in size."""
    return rasters.groupBy("tile_id").agg(F.count_distinct("height", "width").alias("shapes")).filter("shapes > 1")
