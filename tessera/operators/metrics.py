"""Confusion tables, what is derived from them, threshold curves and losses.

Pixels are read once: they are aggregated to (keys, truth, prediction) counts with partial sums, and everything by
class follows from that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-10


def confusion_counts(pixels: DataFrame, *keys: str) -> DataFrame:
    """``keys, gt, pred, n``. A plain grouped count, so it also runs over streams."""
    return pixels.groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))


def confusion_ovr(pixels: DataFrame, keys: list[str] | None = None, labels=range(5)) -> DataFrame:
    """One against the rest for each class: ``keys, class, true_pos, false_pos, false_neg, true_neg, total``."""
    keys = keys or []
    cells = confusion_counts(pixels, *keys)
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    by_class = [F.struct(
        F.lit(c).alias("class"), of((F.col("gt") == c) & (F.col("pred") == c)).alias("true_pos"), of((F.col("gt") != c) & (F.col("pred") == c)).alias("false_pos"),
        of((F.col("gt") == c) & (F.col("pred") != c)).alias("false_neg"), of((F.col("gt") != c) & (F.col("pred") != c)).alias("true_neg"), F.sum("n").alias("total"),
    ) for c in labels]
    return cells.groupBy(*keys).agg(F.array(*by_class).alias("rows")).select(*keys, F.inline("rows"))


def confusion_matrix(pixels: DataFrame, labels=range(5)) -> DataFrame:
    """Truth by row, prediction by column, with totals; ``gt`` is null in the row of totals."""
    columns = [F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias(f"p{c}") for c in labels]
    return confusion_counts(pixels).rollup("gt").agg(*columns, F.sum("n").alias("total"))


def sum_confusion(confusion: DataFrame, *keys: str) -> DataFrame:
    """Confusion tables of tiles or batches added up."""
    columns = [c for c in ("true_pos", "false_pos", "false_neg", "true_neg", "total", "true_total", "pred_total") if c in confusion.columns]
    return confusion.groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in columns])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def eval_metrics(confusion: DataFrame, keys: list[str] | None = None, style: str = "pixel") -> DataFrame:
    """``keys, class, precision, recall, f1, accuracy, f1_harmonic_mean``.

    ``style='object'`` takes the totals of objects as denominators and no epsilon in the harmonic mean.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("true_pos", "false_pos", "false_neg", "true_neg"))
    if style == "object":
        p, r, acc = _ratio(tp, F.col("pred_total")), _ratio(tp, tp + fn), _ratio(tp + tn, F.col("true_total"))
    else:
        p, r, acc = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tp + tn, tp + fp + fn + tn)
    rows = confusion.select(*(keys or []), "class", p.alias("precision"), r.alias("recall"), acc.alias("accuracy")).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    # A handful of classes for each key.
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    epsilon = 0.0 if style == "object" else EPSILON
    inverse = F.sum(F.try_divide(F.lit(1.0), F.col("f1") + epsilon)).over(group)
    mean = F.coalesce(F.try_divide(F.count("*").over(group).cast("double"), inverse), F.lit(0.0))
    if style == "object":
        mean = F.when(F.min("f1").over(group) == 0, 0.0).otherwise(mean)
    return rows.withColumn("f1_harmonic_mean", mean)


def harmonic_pair(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0), F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b)), F.lit(0.0))


def weighted_average(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col("val") * F.col("n")), F.sum("n")).alias("mean"))


def cross_entropy(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of -log p(truth) for ``logits, gt``; ``weights`` has a row for each class (``class, weight``)."""
    from tessera.functions.scores import log_loss

    joined = scores.join(F.broadcast(weights), F.col("gt") == F.col("class"))
    return joined.agg(F.try_divide(F.sum(F.col("weight") * log_loss(F.col("logits"), F.col("gt"))), F.sum("weight")).alias("loss"))


def threshold_confusion(scores: DataFrame, k: int = 200, labels=range(5)) -> DataFrame:
    """``class, step, th, true_pos, false_pos, false_neg, true_neg`` for the ``k`` thresholds step / (k - 1), p >= th.

    Each probability is put once into the bin of the greatest threshold it reaches; counts at all thresholds are
    running sums over at most ``k`` bins of each class. ``scores`` has ``probs, gt``.
    """
    steps = k - 1
    by_class = scores.select("gt", F.posexplode("probs").alias("class", "p")).filter(F.col("class").isin(*labels))
    # Guess the bin, then settle the last place by the comparison itself.
    guess = F.floor(F.col("p") * steps)
    reached = F.when((guess + 1).cast("double") / steps <= F.col("p"), guess + 1).when(guess.cast("double") / steps > F.col("p"), guess - 1).otherwise(guess)
    bins = by_class.groupBy("class", F.least(reached, F.lit(steps)).cast("int").alias("step")).agg(
        F.count_if(F.col("gt") == F.col("class")).alias("pos"), F.count_if(F.col("gt") != F.col("class")).alias("neg"))
    spine = bins.select("class").distinct().select("class", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    above = Window.partitionBy("class").orderBy(F.desc("step"))
    whole = Window.partitionBy("class")
    filled = spine.join(bins, ["class", "step"], "left").fillna(0, ["pos", "neg"])
    return filled.select(
        "class", "step", (F.col("step").cast("double") / steps).alias("th"),
        F.sum("pos").over(above).alias("true_pos"), F.sum("neg").over(above).alias("false_pos"),
        (F.sum("pos").over(whole) - F.sum("pos").over(above)).alias("false_neg"), (F.sum("neg").over(whole) - F.sum("neg").over(above)).alias("true_neg"),
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """``class, auc`` from a threshold table: trapezoids over points sorted by (fpr, tpr)."""
    tp, fp, fn, tn = (F.col(c) for c in ("true_pos", "false_pos", "false_neg", "true_neg"))
    points = curve.select("class", "step", (1 - _ratio(tn, tn + fp)).alias("fpr"), _ratio(tp, tp + fn).alias("tpr"))
    order = Window.partitionBy("class").orderBy("fpr", "tpr", F.desc("step"))
    area = (F.col("fpr") - F.lag("fpr").over(order)) * (F.col("tpr") + F.lag("tpr").over(order)) / 2
    return points.withColumn("area", area).groupBy("class").agg(F.sum("area").alias("auc"))


def pr_curve(curve: DataFrame) -> DataFrame:
    """``class, ap, ap_ref, base``: average precision with recall rising; in ascending order of thresholds; and the base precision."""
    tp, fp, fn, tn = (F.col(c) for c in ("true_pos", "false_pos", "false_neg", "true_neg"))
    points = curve.select(
        "class", "step", "true_pos", "true_neg",
        F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(1.0)).alias("precision"), _ratio(tp, tp + fn).alias("recall"))
    down, up = Window.partitionBy("class").orderBy(F.desc("step")), Window.partitionBy("class").orderBy("step")
    return (
        points.withColumn("gain", (F.col("recall") - F.coalesce(F.lag("recall").over(down), F.lit(0.0))) * F.col("precision"))
        .withColumn("gain_ref", (F.col("recall") - F.lag("recall").over(up)) * F.col("precision"))
        .groupBy("class").agg(F.sum("gain").alias("ap"), F.sum("gain_ref").alias("ap_ref"),
                              _ratio(F.max("true_pos"), F.max("true_pos") + F.max("true_neg")).alias("base"))
    )


def running_loss(df: DataFrame, run: list[str], order: str = "epoch") -> DataFrame:
    """The loss as one meter over the whole run reports it, beside the loss of each epoch by itself."""
    so_far = Window.partitionBy(*run).orderBy(order)
    by_epoch = df.groupBy(*run, order).agg(F.sum(F.col("val") * F.col("n")).alias("s"), F.sum("n").alias("w"))
    return by_epoch.select(
        *run, order, F.try_divide(F.sum("s").over(so_far), F.sum("w").over(so_far)).alias("running"), F.try_divide(F.col("s"), F.col("w")).alias("own"))


def best_so_far(df: DataFrame, run: list[str], value: str, order: str = "epoch") -> DataFrame:
    """Whether each epoch is at least as good as all before it, and the best up to it."""
    before = Window.partitionBy(*run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(value).over(before)
    return df.withColumn("is_best", best.isNull() | (F.col(value) >= best)).withColumn("best", F.greatest(F.col(value), best))
