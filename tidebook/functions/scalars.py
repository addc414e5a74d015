"""Small column expressions. Nothing here touches a session or runs a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_PER_MS = 1_000_000


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is NULL for a zero or missing denominator."""
    return F.try_divide(numerator, denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def is_finite(column: Column) -> Column:
    value = column.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def nan_to_null(column: Column) -> Column:
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def clip(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays of equal length, summed in array order."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, term: total + term,
    )


def weights(values: Iterable[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def softmax(logits: Column) -> Column:
    """Probabilities from an array of logits, shifted by the largest one first."""
    shifted = F.transform(logits, lambda z: F.exp(z - F.array_max(logits)))
    return normalise(shifted)


def normalise(raw: Column) -> Column:
    """Array divided by its sum; NULL when the sum is not positive and finite."""
    total = F.aggregate(raw, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(is_finite(total) & (total > 0), F.transform(raw, lambda p: p / total))


def log_sigmoid(score: Column) -> Column:
    """-log(1 + exp(-score)) without overflow for large scores of either sign."""
    return -(F.log1p(F.exp(-F.abs(score))) + F.greatest(-score, F.lit(0.0)))


def one_vs_rest_probabilities(scores: Column) -> Column:
    """Normalised sigmoids of an array of scores, computed in log space."""
    logs = F.transform(scores, log_sigmoid)
    return normalise(F.transform(logs, lambda v: F.exp(v - F.array_max(logs))))


def top_class(probabilities: Column) -> Column:
    """One-based position of the first maximum."""
    return F.array_position(probabilities, F.array_max(probabilities)).cast("int")
