"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step points rows at the least neighbour it can see: a grouped minimum, with partial results before its shuffle,
and a join. Minima are written before they are joined, so that the join has a shuffle of its own, which adaptive
execution splits where a hub holds many of the links. The number of rounds grows with the logarithm of the longest path. Every round's
links are written to the shared workspace, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize


def _least(links: DataFrame) -> DataFrame:
    return materialize(links.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("u"), F.least("a", "least").alias("least")), "least")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    return (
        both.join(_least(both), F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    joined = down.join(least, F.col("a") == F.col("u"))
    return (
        joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
        .union(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
        .filter("a <> b").distinct()
    )


def _print(links: DataFrame):
    return links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b`` long) that isn't its component's least, its root."""
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _print(now)
    for _ in range(max_rounds if mark[0] else 0):
        now = materialize(_small_star(materialize(_large_star(now), "links")), "links")
        last, mark = mark, _print(now)
        if mark == last:
            break
    else:
        if mark[0]:
            raise RuntimeError(f"components haven't settled in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
