"""Vector and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, so large logits don't overflow."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def first_best(scores: Column, names: list[str]) -> Column:
    """Name of the highest score, the first one on ties."""
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(scores, F.array_max(scores)).cast("int"))


def backoff(attempt: Column, base: float = 1.0, cap: float = 30.0) -> Column:
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))


def refilled(left: Column, seconds: Column, per_minute: float) -> Column:
    return F.least(F.lit(float(per_minute)), left + seconds * (per_minute / 60))


def reset_seconds(left: Column, per_minute: float) -> Column:
    return F.when(left >= per_minute, 0.0).otherwise((per_minute - left) / (per_minute / 60))
