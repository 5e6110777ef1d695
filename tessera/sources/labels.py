"""Label files: JSON with one feature for each building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SCHEMA = (
    "features struct<xy: array<struct<wkt: string, properties: struct<feature_type: string, subtype: string, uid: string>>>>"
)


def file_key(path: Column) -> tuple[Column, Column, Column]:
    """Disaster, tile and phase from ``<dis>_<tile>_<pre|post>_disaster...``."""
    parts = F.split(F.element_at(F.split(path, "/"), -1), "_")
    return parts[0], parts[1], parts[2]


def explode_features(labels: DataFrame, *keys: str) -> DataFrame:
    """``keys, wkt, feature_type, subtype, uid``: a row for each feature."""
    return labels.select(*keys, F.explode("features.xy").alias("f")).select(*keys, "f.wkt", "f.properties.feature_type", "f.properties.subtype", "f.properties.uid")


def _files(spark: SparkSession, path: str, phase: str | None) -> DataFrame:
    """One row a file; ``broken`` holds what isn't whole JSON of the right shape. Names of other phases are never opened."""
    glob = f"*_{phase}_disaster.json" if phase else "*_disaster.json"
    reader = spark.read.schema(f"{LABEL_SCHEMA}, broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    raw = reader.option("pathGlobFilter", glob).json(path)
    dis, tile, when = file_key(F.col("_metadata.file_path"))
    return raw.select("features", "broken", dis.alias("dis_id"), tile.alias("tile_id"), when.alias("phase"), F.col("_metadata.file_path").alias("path"))


def read_labels(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """``dis_id, tile_id, phase, wkt, feature_type, subtype, uid`` of all label files under ``path``; ``phase`` reads only its files. See ``label_rejects``."""
    return explode_features(_files(spark, path, phase).filter("broken IS NULL"), "dis_id", "tile_id", "phase")


def label_rejects(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """``path`` of label files that can't be read: cut short, no JSON, or without features."""
    return _files(spark, path, phase).filter("broken IS NOT NULL OR features.xy IS NULL").select("path")


def parse_labels(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """The same from a column that holds the JSON."""
    return explode_features(rows.select(*keys, F.from_json(column, LABEL_SCHEMA).alias("j")).select(*keys, "j.features"), *keys)


def buildings_only(features: DataFrame) -> DataFrame:
    return features.filter(F.col("feature_type") == "building")
