"""Global order without a global task: positions, prefix sums, hash ranks, the greedy order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import settled


def hash_rank(seed: int, *keys: str) -> Column:
    """A hexadecimal string that puts rows in random but reproducible order, alike in every SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """Number rows from 0 in the given total order.

    Rows are range partitioned and sorted there; partitions are counted, and each row adds its place to the
    rows of the partitions before. Ranges come from a sample, so they are settled before they are counted.
    """
    local = 1 << 33
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = (F.col("_at") / local).cast("int")
    sizes = (
        placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
        .select("_part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    )
    # One row for each partition: bounded by the number of partitions, not by rows.
    return (
        placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
        .withColumn(name, F.col("_before") + F.pmod(F.col("_at"), F.lit(local)))
        .drop("_at", "_part", "_before")
    )


def with_group_position(df: DataFrame, group: list[str], *order: Column | str, name: str = "pos", size: str = "size") -> DataFrame:
    """Number the rows of each group from 0 in the given order, which leaves no ties, and add the group's size.

    Rows are range partitioned by group and order together, so a group that holds most of the rows is spread over as many tasks.
    """
    placed = settled(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    every = Window.partitionBy(*[f"_g{i}" for i in range(len(group))])
    earlier = every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition and group in it.
    runs = (
        placed.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
        .withColumns({"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), size: F.sum("_rows").over(every)}).drop("_rows")
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    joined = placed.join(runs, [F.col("_part") == F.col("_p"), *same])
    return joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_p", "_first", "_before", *[f"_g{i}" for i in range(len(group))])


def with_prefix_sum(df: DataFrame, position: str, columns: list[str], block: int = 65_536, group: list[str] | None = None) -> DataFrame:
    """Add ``<column>_upto`` (sum of all rows up to and including this one, by position) for each column, in each ``group``."""
    group = group or []
    blocks = df.withColumn("_block", F.floor(F.col(position) / block))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*group, "_block").agg(*[F.sum(c).alias(c) for c in columns])
    offsets = sums.select(*group, "_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(*group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    # By merging: rows may be exploded ones, which the planner would broadcast. The window needs them by block anyway.
    return (
        blocks.join(offsets.hint("merge"), [*group, "_block"])
        .withColumns({f"{c}_upto": F.col(f"_{c}") + F.sum(c).over(inside) for c in columns})
        .drop("_block", *[f"_{c}" for c in columns])
    )


def sample_n(df: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """The first ``n`` rows in hash order: the same sample on every run."""
    return df.orderBy(hash_rank(seed, *keys), *keys).limit(n)


def imbalance(*counts: Column) -> Column:
    """Population variance of counts times the square of their number; whole numbers, so free of ties by rounding."""
    total = sum(counts, F.lit(0))
    return len(counts) * sum((c * c for c in counts), F.lit(0)) - total * total


def greedy_balance_order(
    tiles: DataFrame, keys: list[str], classes: list[str], group: list[str] | None = None, max_picks: int | None = None
) -> DataFrame:
    """Order tiles so that each next one leaves the running class totals least imbalanced; adds ``pos`` from 0.

    Only count vectors matter, so the choice is made among distinct vectors with their multiplicities, in one
    task per group: far fewer rows than tiles, and none of their payload. That task holds the distinct vectors, takes choices that repeat in one
    step (``_stretches``) and hands out such stretches; tiles are made of them and joined to them in many tasks. Equal choices go to the smaller vector,
    then to the smaller ``keys``. ``group`` gives each group an order of its own, in parallel; ``max_picks`` stops
    each order early, where only its beginning is used.
    """
    group = group or []
    counted = tiles.withColumns({c: F.col(c).cast("long") for c in classes})
    numbered = with_group_position(counted, [*group, *classes], *keys, name="_nth", size="_copies")
    # The first tile of each vector stands for it, so that tiles aren't counted again.
    signatures = numbered.filter("_nth = 0").select(*group, *[f"`{c}`" for c in classes], "_copies")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in signatures.drop("_copies").schema.fields]
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By number, or groups of few vectors would be put together into one task. A shuffle even into one part: the vectors are found in many tasks.
    together = signatures.repartition(parts, *group) if group else signatures.repartition(1)
    found = [*fields, "_nth long", "pos long", "_each long", "_length long", "_times long"]
    stretches = settled(together.sortWithinPartitions(*group, *classes).mapInPandas(_chooser(group, classes, max_picks), ", ".join(found)))
    again = stretches.repartition(parts).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    order = again.select(*group, *[f"`{c}`" for c in classes], (F.col("_nth") + F.col("_i") * F.col("_each")).alias("_nth"), (F.col("pos") + F.col("_i") * F.col("_length")).alias("pos"))
    # The order has a row for each tile, though it comes from few vectors: by merging, or the planner would broadcast it.
    return numbered.drop("_copies").join(order.hint("merge"), [*group, *classes, "_nth"]).drop("_nth")


def _chooser(group: list[str], classes: list[str], max_picks: int | None, piece: int = 65_536):
    """Rows of a stretch: the place of a vector's copy (``_nth``) and of its pick (``pos``), and how far both go on each of ``_times`` times."""
    def choices(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        counts, copies = rows[classes].to_numpy("int64"), rows["_copies"].to_numpy("int64")
        taken, at = copies * 0, 0
        for chosen, times in _stretches(counts, copies, int(min(copies.sum(), max_picks or copies.sum()))):
            used, order = np.bincount(chosen, minlength=len(counts)), np.argsort(chosen, kind="stable")
            before = np.empty_like(order)  # earlier uses of the same vector in the stretch
            before[order] = np.arange(len(order)) - np.repeat(np.cumsum(used) - used, used)
            for done in range(0, times, piece):
                yield rows.iloc[chosen][[*group, *classes]].assign(
                    _nth=taken[chosen] + before + done * used[chosen], pos=at + np.arange(len(chosen)) + done * len(chosen),
                    _each=used[chosen], _length=len(chosen), _times=min(piece, times - done))
            taken, at = taken + times * used, at + times * len(chosen)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            if group and len(held):
                # Sorted by group: all but the last group are complete.
                last = (held[group] == held[group].iloc[-1]).all(axis=1)
                for _, rows in held[~last].groupby(group, sort=False):
                    yield from choices(rows.reset_index(drop=True))
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield from choices(held)

    return run


def _stretches(counts: np.ndarray, copies: np.ndarray, picks: int, first: int = 512, most: int = 16_384) -> Iterator[tuple[np.ndarray, int]]:
    """The first ``picks`` choices among vectors, as stretches (vectors, times): a stretch is picked so many times in a row.

    Choices soon repeat, as picks undo what earlier ones left out of balance, until a vector is used up. Single steps are taken for a while; where the last ones are two turns of one
    stretch, all turns that are sure to follow are taken at once.
    """
    left, sums, scaled = copies.copy(), counts.sum(axis=1), counts * counts.shape[1]
    # The imbalance after each choice, less that of the totals so far, which is the same for all: a pick adds its products with the vectors.
    cost = (scaled * counts).sum(axis=1) - sums * sums
    added = lambda best: 2 * (scaled @ counts[best] - sums * sums[best])
    if len(counts) <= 2000:  # 32 MB at most
        added = (2 * (scaled @ counts.T - np.outer(sums, sums))).__getitem__
    at, size, recent = 0, first, []
    while at < picks:
        chosen = []
        for _ in range(min(size, picks - at)):
            best = int(cost.argmin())
            cost += added(best)
            left[best] -= 1
            if not left[best]:
                cost[best] = 1 << 62  # used up; what later picks add is far less
            chosen.append(best)
        yield np.array(chosen), 1
        at += len(chosen)
        recent = (recent + chosen)[-2 * most :]
        length = _period(recent)
        turn = np.array(recent[len(recent) - length :], dtype=int)
        times = _turns(turn, counts, left, cost, added, (picks - at) // length) if length else 0
        if times:
            cost += times * sum(added(best) for best in turn)
            left -= times * np.bincount(turn, minlength=len(left))
            cost[left == 0] = 1 << 62
            yield turn, times
            at += times * length
            recent = []
        size = first if times * length > size else min(2 * size, most)


def _period(chosen: list[int]) -> int:
    """The length of what the longest end of ``chosen`` that repeats something consists of; 0 if none does. By the borders of the reversed list."""
    back, border, k, length = chosen[::-1], [0] * len(chosen), 0, 0
    for i in range(1, len(back)):
        while k and back[i] != back[k]:
            k = border[k - 1]
        k += back[i] == back[k]
        border[i] = k
        if i + 1 >= 2 * (i + 1 - k):
            length = i + 1 - k
    return length


def _turns(turn: np.ndarray, counts: np.ndarray, left: np.ndarray, cost: np.ndarray, added, most: int) -> int:
    """How many times ``turn`` follows from here. Each turn changes costs by the same whole numbers, so for each of its picks the lead over every other vector falls or grows in a
    straight line, and the turn in which it is lost follows by division; nor can a vector be picked more often than there are copies."""
    used = np.bincount(turn, minlength=len(left))
    times = min(most, int((left[used > 0] // used[used > 0]).min()))
    drift, now, there = sum(added(best) for best in turn), cost.copy(), left > 0
    for best in turn:
        if times <= 0:
            return 0
        # Equal costs go to the smaller vector.
        lead = (now - now[best] - (np.arange(len(left)) < best))[there]
        if (lead < 0).any():
            return 0
        falls = (drift - drift[best])[there]
        if (falls < 0).any():
            times = min(times, 1 + int((lead[falls < 0] // -falls[falls < 0]).min()))
        now += added(best)
    return times
