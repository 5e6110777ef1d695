"""Splits, folds, grids and samples, all reproducible: order is the hash of a seed and the keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.labels import copy_id
from tessera.operators.lineage import settled
from tessera.operators.ordering import hash_rank, with_group_position

#: Rarest damage first: a tile belongs to the first class it has.
STRATA = ("destroyed", "major-damage", "minor-damage", "no-damage")


def _cells(df: DataFrame, seed: int, keys: tuple[str, ...], rows_per_cell: int) -> tuple[DataFrame, int]:
    df = settled(df)
    total = df.count()
    cells = max(1, -(-total // rows_per_cell))
    h = df.withColumn("_h", hash_rank(seed, *keys))
    return h.withColumn("_cell", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) * cells)), total


def hash_position(df: DataFrame, seed: int, *keys: str, rows_per_cell: int = 1_000_000) -> tuple[DataFrame, int]:
    """Add ``pos``, each row's place in hash order, and return the number of rows.

    Hashes are uniform, so ranges of them hold about equal numbers; ranges are counted and rows ranked within. Rows are settled
    first, since they are read three times.
    """
    cells, total = _cells(df, seed, keys, rows_per_cell)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.groupBy("_cell").agg(F.count("*").alias("n")).select("_cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_cell").orderBy("_h", *keys)
    return cells.join(before, "_cell").withColumn("pos", F.col("_before") + F.row_number().over(inside) - 1).drop("_h", "_cell", "_before"), total


def split_sizes(total: int, props: dict[str, float]) -> dict[str, int]:
    """Sizes in sequence: each takes its share of what is left, rounded half to even; the last takes all."""
    if abs(sum(props.values()) - 1) > 1e-9:
        raise ValueError(f"proportions must add up to 1, not {sum(props.values())}")
    left, share, sizes = total, 1.0, {}
    for i, (name, p) in enumerate(props.items()):
        sizes[name] = left if i == len(props) - 1 else round(left * (p / share))
        left -= sizes[name]
        share -= p
    return sizes


def split_random(tiles: DataFrame, props: dict[str, float], *keys: str, seed: int = 0) -> DataFrame:
    """Add ``split``: proportional parts of the hash order."""
    placed, total = hash_position(tiles, seed, *keys)
    upto, out = 0, F.lit(None).cast("string")
    for name, size in split_sizes(total, props).items():
        out = F.when(F.col("pos").between(upto, upto + size - 1), name).otherwise(out)
        upto += size
    return placed.withColumn("split", out)


def stratum(labels=STRATA) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(labels):
        out = F.when(F.col(f"`{name}`") > 0, name).otherwise(out)
    return out


def split_stratified(counts: DataFrame, props: dict[str, float], seed: int = 0, labels=STRATA) -> DataFrame:
    """Split each disaster's tiles of each stratum alike; tiles without damage classes go to the last split.

    ``counts`` has ``dis_id, tile_id`` and a column for each label. Each split takes the floor of its share of what
    is left in the stratum.
    """
    marked = counts.withColumns({"stratum": stratum(labels), "_h": hash_rank(seed, "dis_id", "tile_id")})
    placed = with_group_position(marked, ["dis_id", "stratum"], "_h", "tile_id", name="_place", size="_n").drop("_h")
    names = list(props)
    cut, left, share, out = F.lit(0).cast("long"), F.col("_n"), 1.0, F.lit(names[-1])
    cuts = []
    for name in names[:-1]:
        size = F.floor(left * F.lit(props[name] / share))
        cuts.append((name, cut, cut + size))
        cut, left, share = cut + size, left - size, share - props[name]
    for name, start, end in reversed(cuts):
        out = F.when((F.col("_place") >= start) & (F.col("_place") < end), name).otherwise(out)
    return placed.withColumn("split", F.when(F.col("stratum").isNull(), names[-1]).otherwise(out)).drop("_n", "_place")


def assign_folds(df: DataFrame, k: int, *keys: str, seed: int = 0) -> DataFrame:
    """Add ``fold`` 0 to k-1 in hash order; the first folds get the rows that are over."""
    if k < 2:
        raise ValueError("cross-validation needs two folds at least")
    placed, total = hash_position(df, seed, *keys)
    size, over = divmod(total, k)
    big = over * (size + 1)
    pos = F.col("pos")
    rest = F.lit(0) if size == 0 else F.floor((pos - big) / size)
    return placed.withColumn("fold", F.when(pos < big, F.floor(pos / (size + 1))).otherwise(over + rest).cast("int")).drop("pos")


def pick(seed: int, n: Column, *parts: Column | str) -> Column:
    """A number in [0, n) drawn by hash: sampling with replacement."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % n


def sample_with_replacement(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """``n`` draws of rows of ``df``; ``copy`` numbers the draws of one row from 1, so each has an id of its own."""
    placed, total = hash_position(df, seed, *keys)
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), pick(seed, F.lit(max(total, 1)), F.lit("draw"), "id").alias("pos"))
    copies = Window.partitionBy("pos").orderBy("draw")
    return placed.join(draws, "pos").withColumn("copy", F.row_number().over(copies)).drop("pos")


def param_grid(spark: SparkSession, params: dict[str, list], defaults: dict | None = None) -> DataFrame:
    """All combinations; keys sorted, the last varies fastest; ``conf_id`` from 0."""
    grid, number, names = spark.range(1).select(), F.lit(0), sorted(params)
    for name in names:
        values = F.array(*[F.struct(F.lit(i).alias(f"_{name}"), F.lit(v).alias(name)) for i, v in enumerate(params[name])])
        grid = grid.select("*", F.inline(values)) if grid.columns else spark.range(1).select(F.inline(values))
        number = number * len(params[name]) + F.col(f"_{name}")
    constants = [F.lit(v).alias(k) for k, v in (defaults or {}).items() if k not in params]
    return grid.select(number.cast("int").alias("conf_id"), *names, *constants)


def attach_copies(picked: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sampled ids joined to their catalog rows; the i-th copy of a tile in a split gets an id of its own."""
    order = Window.partitionBy("split", "dis_id", "tile_id").orderBy(*[c for c in picked.columns if c not in ("split", "dis_id", "tile_id")] or ["tile_id"])
    numbered = picked.withColumn("copy_no", F.row_number().over(order))
    return numbered.join(catalog, ["dis_id", "tile_id"]).withColumn("copy_id", copy_id(F.col("copy_no"), F.col("tile_id")))
