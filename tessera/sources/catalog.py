"""Catalogs of tiles and patches from file names, and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("image", "json", "mask")
SLOTS = tuple(f"{phase}_{kind}" for phase in ("pre", "post") for kind in KINDS)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths under ``path``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def parse_names(paths: DataFrame, column: str = "path") -> DataFrame:
    """``path, dis_id, tile_id, phase, kind``; kind is null for names that aren't a tile's."""
    name = F.element_at(F.split(F.col(column), "/"), -1)
    parts = F.split(name, "_")
    last = F.element_at(parts, -1)
    kind = (
        F.when((F.size(parts) == 5) & (F.get(parts, F.lit(3)) == "disaster") & (last == "target.png"), "mask")
        .when((F.size(parts) == 4) & (last == "disaster.png"), "image")
        .when((F.size(parts) == 4) & (last == "disaster.json"), "json")
    )
    phase = F.get(parts, F.lit(2))
    return paths.select(
        F.col(column).alias("path"), F.get(parts, F.lit(0)).alias("dis_id"), F.get(parts, F.lit(1)).alias("tile_id"), phase.alias("phase"),
        F.when(phase.isin("pre", "post"), kind).alias("kind"))


def tile_catalog(paths: DataFrame, column: str = "path") -> tuple[DataFrame, DataFrame]:
    """The catalog, and the names that were rejected."""
    named = parse_names(paths, column)
    return named.filter(F.col("kind").isNotNull()), named.filter(F.col("kind").isNull()).select("path")


def check_catalog(catalog: DataFrame) -> DataFrame:
    """Tiles that lack a file or have one twice, with the count of each of the six."""
    slot = F.concat_ws("_", "phase", "kind")
    counts = catalog.groupBy("dis_id", "tile_id").agg(*[F.count_if(slot == s).alias(s) for s in SLOTS])
    odd = F.lit(False)
    for s in SLOTS:
        odd = odd | (F.col(s) != 1)
    return counts.filter(odd)


def filter_disasters(catalog: DataFrame, disasters: list[str] | str) -> DataFrame:
    """Rows whose disaster begins with one of the names; ``all`` keeps everything."""
    wanted = [disasters] if isinstance(disasters, str) else list(disasters)
    if "all" in wanted:
        return catalog
    keep = F.lit(False)
    for prefix in wanted:
        keep = keep | F.startswith("dis_id", F.lit(prefix))
    return catalog.filter(keep)


def predicted_catalog(paths: DataFrame, column: str = "path") -> DataFrame:
    """``path, dis_id, tile_id, patch_id`` of predicted patches, ``<dis>_<tile>_<patch>_dmg_mask.png``."""
    found = lambda i: F.regexp_extract(F.col(column), r"([^/_]+)_([^/_]+)_([0-9]+)_dmg_mask\.png$", i)
    return paths.select(F.col(column).alias("path"), found(1).alias("dis_id"), found(2).alias("tile_id"), found(3).alias("patch_id")).filter("patch_id <> ''")


def patch_manifest(patches: DataFrame, tiles: DataFrame) -> DataFrame:
    """Patches with the paths of their tile's original images (``org_pre``, ``org_post``)."""
    images = tiles.filter("kind = 'image'").groupBy("dis_id", "tile_id").agg(
        F.max(F.when(F.col("phase") == "pre", F.col("path"))).alias("org_pre"), F.max(F.when(F.col("phase") == "post", F.col("path"))).alias("org_post"))
    return patches.join(images, ["dis_id", "tile_id"], "left")


def pivot_catalog(catalog: DataFrame) -> DataFrame:
    """One row for each tile, a path column for each of the six files."""
    return catalog.groupBy("dis_id", "tile_id").pivot("slot", list(SLOTS)).agg(F.first("path")) if "slot" in catalog.columns else pivot_catalog(
        catalog.withColumn("slot", F.concat_ws("_", "phase", "kind")))
