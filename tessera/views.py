"""Tiles, labels, pixels, scores and polygons, derived from the driver's tables.

Each view is a list of select expressions that Spark and other SQL engines read alike; ``*_SQL`` are the same
views as text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import dealt, parts_for

PIXELS = (
    "l_orderkey AS tile_id",
    "CAST(l_quantity AS INT) % 5 AS gt",
    "CASE l_linenumber % 3 WHEN 0 THEN CAST(round(l_discount * 100) AS INT) % 5 ELSE CAST(l_quantity AS INT) % 5 END AS pred",
)
PIXELS_SQL = f"SELECT {', '.join(PIXELS)} FROM lineitem"

LABEL_OF_QUANTITY = (
    "CASE WHEN l_quantity <= 4 THEN 'destroyed' WHEN l_quantity <= 10 THEN 'major-damage' WHEN l_quantity <= 20 THEN 'minor-damage' "
    "WHEN l_quantity <= 42 THEN 'no-damage' WHEN l_quantity <= 46 THEN 'un-classified' END"
)
BUILDINGS_SQL = (
    f"SELECT c_mktsegment AS dis_id, o_orderkey AS tile_id, {LABEL_OF_QUANTITY} AS label "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
)
SCORES_SQL = (
    "SELECT vec_id AS px_id, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE) * 10) AS logits, label % 2 AS seg, label % 5 AS gt FROM embeddings"
)
CHANNELS = (
    "user_id AS tile_id",
    "CASE WHEN event_id % 2 = 0 THEN 'pre' ELSE 'post' END AS phase",
    "CASE event_type WHEN 'click' THEN 'R' WHEN 'error' THEN 'G' ELSE 'B' END AS channel",
    "CAST(floor(value) AS INT) % 256 AS v",
)
CHANNELS_SQL = f"SELECT {', '.join(CHANNELS)} FROM events WHERE event_type IN ('click', 'error', 'view')"
EPOCHS = (
    "CAST(user_id % 4 AS INT) AS conf",
    "CAST(user_id % 5 AS INT) AS fold",
    "CAST(event_id % 12 + 1 AS INT) AS epoch",
    "value AS val",
    "CAST(1 + event_id % 16 AS BIGINT) AS n",
    "event_id",
)
EPOCHS_SQL = f"SELECT {', '.join(EPOCHS)} FROM events"
#: Twenty polygons to a tile, so that tiles grow in number with the table; their places are mixed up.
POLYGONS = (
    "p_partkey - p_partkey % 20 AS tile_id",
    "p_partkey AS obj",
    "CAST((p_partkey * 7919) % 10007 % 56 AS INT) AS x0",
    "CAST((p_partkey * 6007) % 9973 % 56 AS INT) AS y0",
    "CAST((p_partkey * 7919) % 10007 % 56 + 1 + p_size % 8 AS INT) AS x1",
    "CAST((p_partkey * 6007) % 9973 % 56 + 1 + (p_size * 3) % 8 AS INT) AS y1",
    "CASE p_type WHEN 'PROMO' THEN 4 WHEN 'LARGE' THEN 3 WHEN 'SMALL' THEN 2 WHEN 'ECONOMY' THEN 5 ELSE 1 END AS label",
)
POLYGONS_SQL = f"SELECT {', '.join(POLYGONS)} FROM part"
#: The catalog of tiles: every other one has no building.
TILES = ("p_partkey - p_partkey % 10 AS tile_id",)
TILES_SQL = f"SELECT DISTINCT {TILES[0]} FROM part"
#: Disasters of tiles, and the buildings of a preparation with the keys of their labels.
DISASTER = "concat('d', CAST((tile_id - tile_id % 20) / 20 % 5 AS INT))"
LABEL_KEY = "CASE label WHEN 1 THEN 'no-damage' WHEN 2 THEN 'minor-damage' WHEN 3 THEN 'major-damage' WHEN 4 THEN 'destroyed' ELSE 'un-classified' END"
#: What a network might have predicted: some objects missed, some shifted by a pixel, some labelled otherwise.
PREDICTED = (
    "tile_id",
    "obj",
    "CAST(x0 + obj % 2 AS INT) AS x0",
    "y0",
    "CAST(x1 + obj % 2 AS INT) AS x1",
    "y1",
    "CASE WHEN obj % 7 = 0 THEN label % 4 + 1 ELSE label END AS label",
)
PREDICTED_SQL = f"SELECT {', '.join(PREDICTED)} FROM ({POLYGONS_SQL}) v WHERE obj % 11 <> 0"
WKT = "concat('POLYGON ((', x0, ' ', y0, ', ', x1, ' ', y0, ', ', x1, ' ', y1, ', ', x0, ' ', y1, ', ', x0, ' ', y0, '))') AS wkt"
#: Courts: a slanted outline around a triangular hole. Some hang over the edge of their tile.
COURT = (
    (("x0", "y0"), ("x1 + 5", "y0 + 1"), ("x1 + 3", "y1 + 6"), ("x0 + 1", "y1 + 4")),
    (("x0 + 2", "y0 + 2"), ("x1 + 2", "y0 + 3"), ("x0 + 3", "y1 + 3")),
)
TILE_SIDE = 64


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "lineitem").selectExpr(*PIXELS)


def tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Pixels dealt by tile, for what is counted by tile: as many parts as there are rows for, and no shuffle after that."""
    px = pixels(spark, d)
    return dealt(px, parts_for(px), "tile_id")


def lines_of_tiles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """``dis_id, tile_id`` and ``columns`` of each line, dealt by tile. Customers grow with the orders, so nothing is broadcast."""
    lines = _table(spark, d, "lineitem").selectExpr("l_orderkey", *columns)
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = _table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    parts, by_customer = parts_for(lines), parts_for(orders)
    orders, customers = dealt(orders, by_customer, "o_custkey"), dealt(customers, by_customer, "c_custkey")
    placed = orders.join(customers.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("dis_id")).repartition(parts, "o_orderkey")
    joined = dealt(lines, parts, "l_orderkey").join(placed.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.withColumnRenamed("o_orderkey", "tile_id").drop("l_orderkey")


def buildings(spark: SparkSession, d: str) -> DataFrame:
    return lines_of_tiles(spark, d, f"{LABEL_OF_QUANTITY} AS label").select("dis_id", "tile_id", "label")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(
        F.col("vec_id").alias("px_id"), F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 10).alias("logits"),
        (F.col("label") % 2).alias("seg"), (F.col("label") % 5).alias("gt"),
    )


def channels(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").filter(F.col("event_type").isin("click", "error", "view")).selectExpr(*CHANNELS)


def epochs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").selectExpr(*EPOCHS)


def tiles(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").selectExpr(*TILES).distinct()


def polygons(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").selectExpr(*POLYGONS)


def predicted_polygons(spark: SparkSession, d: str) -> DataFrame:
    return polygons(spark, d).filter("obj % 11 <> 0").selectExpr(*PREDICTED)


def with_wkt(polys: DataFrame) -> DataFrame:
    return polys.selectExpr("*", WKT)


def with_court_wkt(polys: DataFrame) -> DataFrame:
    ring = lambda r: ", ', ', ".join(f"{x}, ' ', {y}" for x, y in (*r, r[0]))
    return polys.selectExpr("*", f"concat('POLYGON ((', {", '), (', ".join(map(ring, COURT))}, '))') AS wkt")
