"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parapet.functions.numbers import round_to


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def literal_vector(values: list[float]) -> Column:
    return F.lit([float(v) for v in values])


def cosine(vector: Column, reference: list[float]) -> Column:
    """Cosine with a constant vector; 0 if either has no length."""
    length = sum(v * v for v in reference) ** 0.5
    if length == 0.0:
        return F.lit(0.0)
    unit = literal_vector([v / length for v in reference])
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, dot(vector, unit) / norm).otherwise(F.lit(0.0))


def drift(vector: Column, reference: list[float]) -> Column:
    """(1 - cosine) / 2, rounded to four digits: 0 aligned, 1 opposite."""
    return round_to((F.lit(1.0) - cosine(vector, reference)) / 2.0, 4)
