"""Rounding and guarded division."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding in plain double arithmetic.

    Sums taken in another order may differ in their last bit; the small term
    makes such values round alike, so results do not depend on partitioning.
    A value too large to have so many digits is returned as it is.
    """
    scale = float(10 ** digits)
    scaled = value * scale
    return F.when(
        F.abs(scaled) < float(2 ** 52), F.floor(scaled + F.lit(0.5 + 1e-7)) / F.lit(scale)
    ).otherwise(value.cast("double"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where whole is 0 or missing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
