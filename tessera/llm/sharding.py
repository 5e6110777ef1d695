"""Proportional stratified interleaving into shards (operator 3), built of DataFrame functions only.

Rows of each source are put into seeded random order and ranked; rank k of n becomes the fraction
(2k-1)/2n. Sorted by that fraction, every stretch of the order holds the sources in their proportions
(to within a row for each source), so cutting it into equal counts gives shards that all match the mixture.

No rank needs all rows of a source, or all rows, in one task. The first order is split into ranges of
(source, hash, id, CRC, size, row number), which has no ties, so ranges hold about equal numbers of rows however
large a source is and however often an id repeats or is null; ranges are counted by source, and a row's rank is
what comes before its range plus its place in it. The second order is split by the fraction, which is uniform by
construction.

Only id, source, size and CRC travel through the two shuffles, never texts.

Defined cases: null text has no bytes (size 16, CRC 0); null sources are a source of their own, after
all others; rows with one ``doc_id`` are told apart by their CRC and size, and rows that agree in all
of these are interchangeable. Fewer rows than shards leave shards empty. No rows give no rows. Of a very long text only its size
and CRC are taken. Columns beside id, text and source never matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import in_order, materialize, seeded_order, table, text_or_empty

OVERHEAD_BYTES = 16
#: The order by fraction is dealt to so many cells at least.
LEAST_CELLS = 64


def _offsets(counts: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Rows before each cell within ``keys``; ``counts`` has one row for each cell."""
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))


def interleave(rows: DataFrame, seed: int = 7, rows_per_cell: int = 50_000) -> DataFrame:
    """Add ``fraction, pos, total`` to rows of ``doc_id, source, size, crc`` (materialised)."""
    total = rows.count()
    cells = max(LEAST_CELLS, math.ceil(total / rows_per_cell))
    hashed = rows.withColumns({"h": seeded_order(seed, F.col("doc_id")), "row": F.monotonically_increasing_id()})
    ordered = in_order(hashed, total, F.asc_nulls_last("source"), "h", "doc_id", "crc", "size", "row")
    counts = ordered.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("local").alias("first"))
    by_source = (
        _offsets(counts, ["source"], "part")
        .withColumn("in_source", F.sum("n").over(Window.partitionBy("source")))
        .select(F.col("source").alias("s"), F.col("part").alias("p"), "first", "before", "in_source")
    )
    ranked = (
        ordered.join(by_source, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .withColumn("rank", F.col("before") + F.col("local") - F.col("first") + 1)
        .withColumn("fraction", (2 * F.col("rank") - 1).cast("double") / (2 * F.col("in_source")).cast("double"))
        .withColumn("slice", F.floor(F.col("fraction") * cells))
        .select("doc_id", "source", "size", "crc", "rank", "fraction", "slice")
    )
    by_slice = _offsets(
        ranked.groupBy("slice").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "slice"
    ).select(F.col("slice").alias("c"), "before")
    within = Window.partitionBy("slice").orderBy("fraction", F.asc_nulls_last("source"), "rank")
    return (
        ranked.withColumn("place", F.row_number().over(within))
        .join(by_slice, F.col("slice") == F.col("c"))
        .withColumn("pos", F.col("before") + F.col("place") - 1)
        .withColumn("total", F.lit(total).cast("long"))
        .select("doc_id", "source", "size", "crc", "fraction", "pos", "total")
    )


def shard(
    docs: DataFrame,
    shards: int = 40,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``doc_id, source, size, text_crc32, fraction, shard, slot``; shard counts differ by one at most."""
    text = text_or_empty(text_col)
    rows = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
        ),
        "shard-rows",
    )
    k = F.lit(shards).cast("long")
    return (
        interleave(rows, seed)
        .withColumn("shard", F.expr(f"pos * {shards} div total").cast("int"))
        .withColumn("slot", F.col("pos") - F.expr(f"(shard * total + {shards - 1}) div {shards}"))
        .select("doc_id", "source", "size", F.col("crc").alias("text_crc32"), "fraction", "shard", "slot")
    )


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op3_stratified_shards": op3_stratified_shards}

#: CRC-32 bit by bit over the bytes of the text; everything else is the definition with plain windows.
ORACLES = {
    "op3_stratified_shards": r"""
        WITH steps AS (
          SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b:
                 CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc_table),
        b AS (
          SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size,
                 md5(concat('7:', doc_id)) AS h,
                 CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(
                     list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS BIGINT)),
                     lambda c, x: xor(c >> 8, crc_table[1 + (xor(c, x) & 255)]), 4294967295), 4294967295) END AS crc
          FROM documents, steps),
        r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, crc, size) AS rank,
                     count(*) OVER (PARTITION BY source) AS in_source FROM b),
        p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * rank - 1 AS DOUBLE) / CAST(2 * in_source AS DOUBLE),
                                           source NULLS LAST, rank) - 1 AS pos, count(*) OVER () AS total FROM r),
        s AS (SELECT *, pos * 40 // total AS shard FROM p)
        SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard,
               CAST(pos - (shard * total + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard
        FROM s"""
}
