"""Class scores of pixels: softmax, argmax, gating, normalisation; higher-order functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Position of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def gate_logits(logits: Column, building: Column) -> Column:
    """Damage scores count only where a building is predicted; elsewhere all classes score alike."""
    return F.transform(logits, lambda x: x * building)


def log_loss(logits: Column, truth: Column) -> Column:
    """-log of the softmax probability of the true class, by log-sum-exp."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.log(total) + top - F.get(logits, truth)


def normalized(value: Column, mean: Column, deviation: Column, floor: float | None = 1e-6) -> Column:
    """(value / 255 - mean) / deviation; a deviation of 0 becomes ``floor`` (null: left alone, so null results)."""
    if floor is not None:
        deviation = F.when(deviation == 0, F.lit(floor)).otherwise(deviation)
    return F.try_divide(value / 255 - mean, deviation)
