"""Balanced samples: best slices of a greedy order, replacement plans, clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.labels import BUILDING_KEYS, DAMAGE_KEYS
from tessera.operators.lineage import settled
from tessera.operators.ordering import greedy_balance_order, hash_rank, imbalance, with_group_position, with_prefix_sum
from tessera.operators.split import pick
from tessera.operators.stats import split_by_presence


def slice_scores(ordered: DataFrame, n: int, betas: list[float], include_last: bool = True, labels=DAMAGE_KEYS, all_labels=BUILDING_KEYS) -> DataFrame:
    """``beta, start, score`` of every stretch of ``n`` rows by ``pos``: 100 (1 - beta) f1 - 100 beta f2.

    f1 is the stretch's number of buildings, f2 the imbalance of its damage classes, both scaled to [0, 1] over all
    stretches. Positions go on from 0 without gaps. Sums of stretches are differences of running sums within a block of positions, which also holds the ``n`` - 1 rows after it.
    """
    columns, block = sorted({*labels, *all_labels}), max(65_536, n)
    home = F.floor(F.col("pos") / block)
    blocks = ordered.select("pos", *[f"`{c}`" for c in columns]).withColumn(
        "_block", F.explode(F.array_distinct(F.array(home, F.floor((F.col("pos") - (n - 1)) / block))))).filter("_block >= 0")
    order = Window.partitionBy("_block").orderBy("pos")
    upto = blocks.withColumns({f"{c}_upto": F.sum(f"`{c}`").over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    ends = upto.withColumns({f"{c}_end": F.lead(f"`{c}_upto`", n - 1).over(order) for c in columns}).filter((F.col("_block") == home) & F.col(f"`{columns[0]}_end`").isNotNull())
    sums = ends.select(F.col("pos").alias("start"), *[(F.col(f"`{c}_end`") - F.col(f"`{c}_upto`") + F.col(f"`{c}`")).alias(c) for c in columns])
    raw = sums.select("start", sum((F.col(f"`{c}`") for c in all_labels), F.lit(0)).alias("f1"), imbalance(*[F.col(f"`{c}`") for c in labels]).alias("f2"))
    if not include_last:
        raw = raw.filter(F.col("start") < ordered.agg(F.max("pos")).first()[0] - n + 1)
    raw = settled(raw)
    ends_of = raw.agg(F.min("f1").alias("l1"), F.max("f1").alias("h1"), F.min("f2").alias("l2"), F.max("f2").alias("h2"))
    scaled = raw.join(F.broadcast(ends_of)).select(
        "start", F.coalesce(F.try_divide(F.col("f1") - F.col("l1"), F.col("h1") - F.col("l1")), F.lit(0.0)).alias("g1"),
        F.coalesce(F.try_divide(F.col("f2") - F.col("l2"), F.col("h2") - F.col("l2")), F.lit(0.0)).alias("g2"))
    return scaled.select(F.explode(F.array(*[F.lit(float(b)) for b in betas])).alias("beta"), "*").select(
        "beta", "start", (100 * (1 - F.col("beta")) * F.col("g1") - 100 * F.col("beta") * F.col("g2")).alias("score"))


def best_slices(ordered: DataFrame, n: int, betas: list[float], **options) -> DataFrame:
    """``beta, n, start, score``: the best stretch for each beta, the first where equal."""
    scored = slice_scores(ordered, n, betas, **options)
    best = F.max_by(F.struct("start", "score"), F.struct(F.round("score", 9), -F.col("start")))
    return scored.groupBy("beta").agg(best.alias("best")).select("beta", F.lit(n).alias("n"), "best.start", "best.score")


def balanced_sample(counts: DataFrame, total: int, beta: float = 0.7, seed: int = 0, empty_share: float = 0.2) -> DataFrame:
    """``dis_id, tile_id, kind, draw``: the best slice of damaged tiles, and empty tiles drawn with replacement.

    Empty tiles make up ``empty_share`` of ``total``, dealt to disasters by their share of the slice.
    """
    damaged, empty = split_by_presence(counts)
    n_empty = int(total * empty_share)
    n = total - n_empty
    ordered = greedy_balance_order(damaged, ["dis_id", "tile_id"], list(DAMAGE_KEYS))
    start = best_slices(ordered, n, [beta]).first()
    if start is None:
        raise ValueError(f"fewer than {n} tiles have damage classes")
    chosen = settled(ordered.filter(F.col("pos").between(start["start"], start["start"] + n - 1)).select("dis_id", "tile_id"))
    shares = chosen.groupBy("dis_id").agg(F.bround(F.count("*") * F.lit(n_empty) / n).cast("int").alias("wanted"))
    pool = with_group_position(empty.select("dis_id", "tile_id"), ["dis_id"], "tile_id", name="at")
    draws = shares.filter("wanted > 0").select("dis_id", F.explode(F.sequence(F.lit(1), F.col("wanted"))).alias("draw"))
    sizes = pool.groupBy("dis_id").agg(F.max("size").alias("size"))
    drawn = draws.join(sizes, "dis_id").withColumn("at", pick(seed, F.col("size"), "dis_id", "draw")).join(pool.drop("size"), ["dis_id", "at"])
    return chosen.select("dis_id", "tile_id", F.lit("damaged").alias("kind"), F.lit(0).alias("draw")).unionByName(
        drawn.select("dis_id", "tile_id", F.lit("empty").alias("kind"), "draw"))


def replacement_plan(buildings: DataFrame, minority: str, seed: int = 0) -> DataFrame:
    """Buildings of other classes to replace, by tile, and their donors of the minority class in the same disaster.

    ``buildings`` has ``dis_id, tile_id, obj, label``. The rate of a tile is one of .5, .6, .7, .8, .9 by hash; donors are
    drawn with replacement.
    """
    classes = F.col("label").isin(*DAMAGE_KEYS)
    order = Window.partitionBy("dis_id", "tile_id").orderBy(hash_rank(seed, "obj"), "obj")
    rate = (5 + pick(seed, F.lit(5), F.lit("rate"), "dis_id", "tile_id")).cast("double") / 10
    hosts = buildings.filter(classes & (F.col("label") != minority)).withColumns({
        "rate": rate, "n": F.count("*").over(Window.partitionBy("dis_id", "tile_id")), "at": F.row_number().over(order)})
    replaced = hosts.filter(F.col("at") <= F.bround(F.col("n") * F.col("rate")))
    # Placing sorts by a sample first: kept, so that the buildings are made once for both.
    donors = settled(buildings.filter(F.col("label") == minority).select("dis_id", F.col("obj").alias("donor"), "tile_id"))
    placed = with_group_position(donors, ["dis_id"], "donor", "tile_id", name="donor_at").select("dis_id", "donor_at", "donor")
    # One row for each disaster: a shuffle by disaster would put all its replaced buildings into one part.
    sizes = F.broadcast(donors.groupBy("dis_id").agg(F.count("*").alias("donors")))
    return (
        replaced.join(sizes, "dis_id").withColumn("donor_at", pick(seed, F.col("donors"), F.lit("donor"), "obj")).join(placed, ["dis_id", "donor_at"])
        .select("dis_id", "tile_id", "obj", "label", "rate", "donor")
    )


def clones_needed(gains: DataFrame, block: int = 4096) -> DataFrame:
    """Clones to add until a class reaches its disaster's largest: candidate clones whose earlier gains, ``gained``, fall short.

    ``gains`` has ``dis_id, clone, gain, deficit`` and whatever else a clone carries, clone numbering candidates from 1. Clones carry what their disaster has, so they join nothing for it.
    """
    return with_prefix_sum(gains, "clone", ["gain"], block, group=["dis_id"]).withColumn("gained", F.col("gain_upto") - F.col("gain")).drop("gain_upto").filter("gained < deficit")


def balance_step(counts: DataFrame, minority: str, seed: int = 0, block: int = 4096) -> DataFrame:
    """The clones that bring ``minority`` up to the largest class (un-classified buildings are one), by disaster: host tile, rate, gain.

    The host is one tile, drawn by hash among those that hold the class; each clone gains the host's own buildings of
    the class and those replaced at the clone's rate. A disaster without a building of the class has no host. Candidates
    are made and summed ``block`` at a time, so that those of one disaster are spread over tasks.
    """
    classes = [k for k in BUILDING_KEYS if k in counts.columns]
    others = sum((F.col(f"`{k}`") for k in classes if k != minority), F.lit(0))
    host = F.struct(hash_rank(seed, "dis_id", "tile_id").alias("h"), F.col("tile_id"), F.col(f"`{minority}`").alias("own"), others.alias("others"))
    # One row for each disaster, kept: candidates are made from it twice.
    totals = settled(counts.groupBy("dis_id").agg(*[F.sum(f"`{k}`").alias(k) for k in classes], F.min(F.when(F.col(f"`{minority}`") > 0, host)).alias("host")).select(
        "dis_id", "host.tile_id", "host.own", "host.others", (F.greatest(*[F.col(f"`{k}`") for k in classes]) - F.col(f"`{minority}`")).alias("deficit")))
    # At the least rate a clone gains own + bround(others / 2), which is one building at least: so many clones always reach the deficit.
    least = F.col("own") + F.bround(F.col("others") * F.lit(0.5)).cast("long")
    needed = totals.filter("deficit > 0 AND own IS NOT NULL").withColumn("most", F.ceil(F.col("deficit") / least))
    candidates = _candidates(needed, block)
    rate = (5 + pick(seed, F.lit(5), F.lit("clone"), "dis_id", "clone")).cast("double") / 10
    gains = candidates.withColumn("gain", F.col("own") + F.bround(F.col("others") * rate).cast("long"))
    return clones_needed(gains, block).select("dis_id", "clone", "gain", "gained", "deficit", "tile_id")


def balance_plan(buildings: DataFrame, seed: int = 0, block: int = 4096, tiles: DataFrame | None = None) -> DataFrame:
    """Clones that bring every damage class of every disaster up to the disaster's largest class, the smallest first.

    ``buildings`` has ``dis_id, tile_id, obj, label``. The largest class may be the un-classified buildings or, where ``tiles`` (``dis_id, tile_id``) is given, the tiles
    without a building; neither is brought up itself, and un-classified buildings of a host are replaced like others. A class has one host, a tile that holds it; each clone of the host keeps its buildings of the class,
    replaces others at the clone's rate, and keeps the rest. So clones for one class add to others as well, and what they add is carried to the classes that
    follow: one step for each of the at most four places in a disaster's order, over tables of clones and totals only.

    ``dis_id, place, label, clone, tile_id, replaced, gain, gained, deficit``: ``gained`` is what earlier clones for the class have added to it.
    """
    known = buildings.filter(F.col("label").isin(*BUILDING_KEYS))
    by_tile = known.groupBy("dis_id", "tile_id", "label").agg(F.count("*").alias("n"))
    # At most five rows for each disaster.
    every = Window.partitionBy("dis_id")
    totals = by_tile.groupBy("dis_id", "label").agg(
        F.sum("n").alias("total"), F.min(F.struct(hash_rank(seed, "dis_id", "label", "tile_id").alias("h"), F.col("tile_id"), F.col("n").alias("own"))).alias("host"))
    totals = totals.withColumn("target", F.max("total").over(every))
    if tiles is not None:
        built = buildings.select("dis_id", "tile_id").distinct()
        empty = tiles.select("dis_id", "tile_id").distinct().join(built, ["dis_id", "tile_id"], "left_anti").groupBy("dis_id").agg(F.count("*").alias("empty"))
        totals = totals.join(empty, "dis_id", "left").withColumn("target", F.greatest("target", F.coalesce("empty", F.lit(0)))).drop("empty")
    ranked = settled(totals.filter(F.col("label").isin(*DAMAGE_KEYS)).withColumn("place", F.row_number().over(every.orderBy("total", "label"))))
    # The buildings of all hosts at once, at most four tiles in a disaster, or each place would make all buildings again.
    hosts = F.broadcast(ranked.select("dis_id", "host.tile_id", F.col("label").alias("minority")))
    others = settled(known.join(hosts, ["dis_id", "tile_id"]).filter("label <> minority").select("dis_id", "minority", "obj", F.col("label").alias("other")))
    carried, steps = ranked.select("dis_id", "label", F.lit(0).cast("long").alias("more")), []
    for place in range(1, len(DAMAGE_KEYS) + 1):
        now = ranked.filter(F.col("place") == place).join(carried, ["dis_id", "label"]).select(
            "dis_id", "label", "host.tile_id", "host.own", (F.col("target") - F.col("total") - F.col("more")).alias("deficit")).filter("deficit > 0")
        rest = settled(others.join(now.select("dis_id", F.col("label").alias("minority")), ["dis_id", "minority"]))
        step = settled(_clones(now, rest, place, seed, block))
        order = Window.partitionBy("dis_id", "block", "clone").orderBy(hash_rank(seed, "clone", "obj"), "obj")
        # A host's buildings meet the clones block by block, so a disaster with many clones is many keys.
        blocks = step.withColumn("block", F.floor(F.col("clone") / block))
        spread = rest.join(blocks.select("dis_id", "block").distinct(), "dis_id")
        kept = blocks.join(spread.hint("merge"), ["dis_id", "block"]).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") > F.col("replaced")).groupBy(
            "dis_id", F.col("other").alias("label")).agg(F.count("*").alias("more"))
        added = step.groupBy("dis_id", "label").agg(F.sum("gain").alias("more"))
        carried = settled(carried.unionByName(kept).unionByName(added).groupBy("dis_id", "label").agg(F.sum("more").alias("more")))
        steps.append(step)
    out = steps[0]
    for step in steps[1:]:
        out = out.unionByName(step)
    return out


def _parts(df: DataFrame) -> int:
    """Parts for blocks of clones, by number: blocks are small, so parts sized by them would be put together before their clones are made."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _candidates(needed: DataFrame, block: int) -> DataFrame:
    """``needed`` with ``clone``, from 1 to its ``most``: dealt in blocks, so that those of one disaster are made in many tasks."""
    blocks = needed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / block)))).repartition(_parts(needed), "dis_id", "block")
    return blocks.withColumn("clone", F.explode(F.sequence((F.col("block") * block + 1).cast("int"), F.least((F.col("block") + 1) * block, F.col("most")).cast("int")))).drop("block", "most")


def _clones(now: DataFrame, rest: DataFrame, place: int, seed: int, block: int) -> DataFrame:
    """The clones of each disaster's class ``now``, until its deficit is met."""
    others = rest.groupBy("dis_id").agg(F.count("*").alias("others"))
    least = F.col("own") + F.bround(F.col("others") * F.lit(0.5)).cast("long")
    sized = now.join(others, "dis_id", "left").withColumn("others", F.coalesce("others", F.lit(0))).withColumn("most", F.ceil(F.col("deficit") / least))
    rate = (5 + pick(seed, F.lit(5), F.lit("clone"), "dis_id", "label", "clone")).cast("double") / 10
    gains = _candidates(sized, block).withColumn("replaced", F.bround(F.col("others") * rate).cast("long")).withColumn("gain", F.col("own") + F.col("replaced"))
    return clones_needed(gains, block).select("dis_id", F.lit(place).alias("place"), "label", "clone", "tile_id", "replaced", "gain", "gained", "deficit")
