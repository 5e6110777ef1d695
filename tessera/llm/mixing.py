"""Mixing sources to target weights by weighted fair queueing (operator 8), DataFrame functions only.

Each source queues its documents in seeded random order, up to ``max_epochs`` times over. A document's
virtual finish time is the source's words up to and including it, divided by the source's target. Taking
documents in the order of their finish times serves all sources in proportion to their targets at every
moment; the order is cut where the total budget is spent. All documents that finish by time 1 fit the
budget by construction; what rounding to whole documents leaves over is filled from just beyond it.

Nothing is summed up in one task. All documents are cut into ranges of (source, hash, text hash, file, place), which has
no ties; sums of the ranges give the offsets. The global order is cut into ``slices`` ranges of finish time, whose sums
(a bounded table) show in which range the budget ends; that range is cut again until it is small enough to be sorted.
Ends of the order are compared as (time, source, epoch, hash, text hash, file, place), so the cut is a single row.

The cut gives each source the last document it serves in each epoch: a table of sources x epochs. By comparing with
it, ``mixed_documents`` takes documents where they stand; their texts are never shuffled.

Targets: sources in order of code points, null last, weigh 1, 2, 3, 1, ... They share the words of all
sources; none gets more than ``max_epochs`` times what it has, and the excess is shared by weight among
the others. That is min(cap, level * weight) for the level at which the targets add up.

Defined cases: null text has no words; a source without words has target 0; documents without words are
not taken; rows that repeat an id, or have none, are served one by one, in order of their texts' hashes; an empty table
gives an empty result. A very long text is counted and hashed where it stands, whole. Columns beside id, text and source never matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import WORD_RUN, in_order, materialize, row_key, scan_of, seeded_order, steps, table, text_or_empty, whole_rows, word_count

#: The range of finish times in which the budget ends is cut until it holds so many ends.
MOST_ENDS = 100_000


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``source, weight, source_size, target`` for rows of ``source, size``; one row per source."""
    everything = Window.partitionBy("all")
    in_order = everything.orderBy(F.asc_nulls_last("source"))
    # Sources that fill first have the least cap for their weight.
    by_need = everything.orderBy((F.col("cap") / F.col("weight")), F.asc_nulls_last("source"))
    upto, onward = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("all", F.lit(0))
        .withColumn("place", F.row_number().over(in_order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", max_epochs * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(onward))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("sharing").cast("double"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
        .select("source", "weight", "source_size", "target")
    )


def _key() -> Column:
    """A row's place in its source's queue; no two rows share it."""
    return F.struct("h", "print", "file", "at")


def _end(finish: Column, epoch: Column) -> Column:
    return F.struct(
        finish.alias("finish"), F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"), epoch.alias("epoch"), _key().alias("key")
    )


def fair_queue(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 11, slices: int = 1024) -> DataFrame:
    """``doc_id, source, size, source_size, target, h, print, file, at, copies`` for materialised ``sized_rows``."""
    n, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = source_targets(sized, weights, max_epochs)
    hashed = sized.withColumn("h", seeded_order(seed, F.col("doc_id")))
    ordered = in_order(hashed, n, F.asc_nulls_last("source"), "h", "print", "file", "at")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ordered.groupBy("source", "part").agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t")))
        .select(F.col("source").alias("s"), F.col("part").alias("p"), "before", "source_size", "target")
    )
    running = Window.partitionBy("part", "source").orderBy("local").rowsBetween(Window.unboundedPreceding, 0)
    queued = materialize(
        ordered.withColumn("upto", F.sum("size").over(running))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
        .withColumn("served", F.col("before") + F.col("upto"))
        .withColumn(
            "ends",
            F.when(
                (F.col("size") > 0) & (F.col("target") > 0),
                F.transform(
                    F.sequence(F.lit(0), F.lit(max_epochs - 1)),
                    lambda e: (e * F.col("source_size") + F.col("served")).cast("double") / F.col("target"),
                ),
            ).otherwise(F.array().cast("array<double>")),
        )
        .drop("s", "p", "part", "local", "before", "upto", "served"),
        "queue",
    )
    cut = _cut(queued, budget, slices)
    if cut is None:
        copies: Column = F.lit(0)
    else:
        key = F.struct(*[F.lit(v).cast(t).alias(k) for (k, v), t in zip(cut["key"].asDict().items(), ("string", "long", "long", "long"), strict=True)])
        last = F.struct(*[F.lit(cut[k]).cast(t).alias(k) for k, t in (("finish", "double"), ("source", "string"), ("none", "boolean"), ("epoch", "int"))], key.alias("key"))
        copies = F.size(F.filter(F.transform("ends", lambda x, e: _end(x, e)), lambda end: end <= last))
    return queued.withColumn("copies", copies.cast("long")).drop("ends")


def _cut(queued: DataFrame, budget: int, slices: int, most: int = MOST_ENDS) -> dict | None:
    """The last end that is taken: one row, however many documents there are."""
    ends = queued.select("*", F.posexplode("ends").alias("epoch", "finish"))
    end = _end(F.col("finish"), F.col("epoch"))

    def last_of(some: DataFrame) -> dict | None:
        last = some.agg(F.max(end).alias("last")).first()["last"]
        return last and last.asDict()

    # All ends by time 1 fit; the budget runs out soon after it, so later ones need no ranges of their own.
    inside, low, width, spent = ends, 0.0, 2.0, 0
    while True:
        placed = inside.withColumn("slice", F.floor(F.least((F.col("finish") - low) / width, F.lit(1.0)) * slices))
        sums = placed.groupBy("slice").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high"))
        # At most slices + 1 rows.
        for crossing in sorted(sums.collect(), key=lambda r: r["slice"]):
            if spent + crossing["words"] >= budget:
                break
            spent += crossing["words"]
        else:
            return last_of(inside)
        inside = placed.filter(F.col("slice") == crossing["slice"])
        low, width = crossing["low"], crossing["high"] - crossing["low"]
        if crossing["n"] <= most or width <= 0:
            break
    order = Window.partitionBy("slice").orderBy(end)
    tail = inside.withColumn("upto", F.sum("size").over(order)).filter(F.col("upto") <= budget - spent)
    return last_of(tail) or last_of(ends.filter(F.col("finish") < low))


def sized_rows(scan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size, print, file, at``: words, the text's hash and the row's key."""
    return scan.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"),
        F.xxhash64(text_or_empty(text_col)).alias("print"), *row_key(scan),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` for every document."""
    queue = fair_queue(materialize(sized_rows(scan_of(docs), id_col, text_col, source_col), "sized"), **options)
    return queue.select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **options) -> DataFrame:
    """The mixture itself: each document as often as it is taken, with the columns it came with."""
    scan = scan_of(docs)
    with steps(docs.sparkSession):
        queue = fair_queue(materialize(sized_rows(scan, id_col, text_col, source_col), "sized"), seed=seed, **options)
        taken = queue.filter("copies > 0").select("source", _key().alias("key"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        last = taken.groupBy("source", "copy").agg(F.max("key").alias("last")).groupBy("source").agg(F.collect_list("last").alias("last"))
        # A row for each source, with as many keys as there are epochs.
        last = materialize(last.select(F.col("source").alias("s"), "last"), "last", lasting=True)
    rows = whole_rows(
        scan, F.col(source_col).cast("string").alias("source"), seeded_order(seed, F.col(id_col)).alias("h"), F.xxhash64(text_or_empty(text_col)).alias("print"),
        F.rlike(text_or_empty(text_col), F.lit(WORD_RUN)).alias("spoken"),
    )
    served = rows.filter("spoken").select("doc", "source", _key().alias("key")).join(last, F.col("source").eqNullSafe(F.col("s")))
    copies = F.size(F.filter("last", lambda x: F.col("key") <= x))
    return served.withColumn("copies", copies).filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op8_fair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


QUERIES = {"op8_fair_mixture": op8_fair_mixture}

ORACLES = {
    "op8_fair_mixture": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                          md5(concat('11:', doc_id)) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
        n AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total,
                     CAST(coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
                     CAST(sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, source NULLS LAST
                                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS sharing FROM s),
        l AS (SELECT max(lev) AS level FROM (SELECT CAST(total - capped AS DOUBLE) / CAST(sharing AS DOUBLE) AS lev, weight, cap FROM n)
              WHERE lev * weight <= cap),
        t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(level, 0e0) * weight) AS target FROM n, l),
        q AS (SELECT d.*, source_size, target,
                     CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size) AS BIGINT) AS served
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT q.*, k.epoch, CAST(k.epoch * source_size + served AS DOUBLE) / target AS finish
              FROM q, (VALUES (0), (1), (2)) k(epoch) WHERE size > 0 AND target > 0),
        o AS (SELECT *, sum(size) OVER (ORDER BY finish, coalesce(source, ''), source IS NULL, epoch, h, doc_id, size) AS upto,
                     (SELECT sum(size) FROM d) AS budget FROM e),
        c AS (SELECT doc_id, count(*) AS copies FROM o WHERE upto <= budget GROUP BY doc_id)
        SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(c.copies, 0) * q.size AS BIGINT) AS taken
        FROM q LEFT JOIN c ON q.doc_id = c.doc_id"""
}
