"""The damage label dictionary and what is done to labels, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Position is the code.
LABELS = (
    ("background", "Background"),
    ("no-damage", "No damage"),
    ("minor-damage", "Minor damage"),
    ("major-damage", "Major damage"),
    ("destroyed", "Destroyed"),
    ("un-classified", "Un-classified"),
)
KEYS = tuple(key for key, _ in LABELS)
DAMAGE_KEYS = KEYS[1:5]
BUILDING_KEYS = KEYS[1:]


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(LABELS)], "code int, key string, name string")


def _lookup(pairs, column: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(pairs)))[column]


def label_code(key: Column) -> Column:
    """The code of a label key; null for what isn't one."""
    return _lookup(((k, i) for i, k in enumerate(KEYS)), key)


def label_key(code: Column) -> Column:
    return _lookup(enumerate(KEYS), code)


def label_name(code: Column) -> Column:
    return _lookup(((i, n) for i, (_, n) in enumerate(LABELS)), code)


def erase_unclassified(code: Column) -> Column:
    """Un-classified buildings count as background in masks."""
    return F.when(code == 5, 0).otherwise(code)


def subtype_or(subtype: Column, on_missing: str = "default") -> Column:
    """Labels without a subtype: ``default`` (no-damage), ``ignore`` (null) or ``error``."""
    if on_missing == "default":
        return F.coalesce(subtype, F.lit("no-damage"))
    if on_missing == "ignore":
        return subtype
    if on_missing == "error":
        return F.coalesce(subtype, F.raise_error(F.lit("a building has no subtype")))
    raise ValueError(f"on_missing is default, ignore or error, not {on_missing}")


def copy_id(n: Column, tile: Column) -> Column:
    """The id of a tile's n-th copy; the first keeps its own."""
    return F.when(n >= 2, F.concat(n.cast("string"), F.lit("a"), tile.cast("string"))).otherwise(tile.cast("string"))
