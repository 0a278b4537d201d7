"""Rounding of report figures and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_one_decimal(value: Column) -> Column:
    """Round the exact binary value to one decimal, ties to even.

    ``round`` and ``bround`` look at the printed decimal, so 0.15 (stored a little below) would go
    up.  Here ten times the value is kept as a sum of two doubles, which loses nothing.
    """
    high = value * 10.0
    part = high - value * 8.0
    error = (value * 8.0 - (high - part)) + (value * 2.0 - part)
    floor = F.floor(high)
    above = high - floor - 0.5
    up = (above > 0) | ((above == 0) & ((error > 0) | ((error == 0) & (floor % 2 == 1))))
    return (floor + F.when(up, 1).otherwise(0)) / 10.0


def dot(a: Column, b: Column) -> Column:
    """Inner product of two numeric arrays, summed in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clipped to [0, 1]; 0 when a side has no length."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.greatest(
        F.lit(0.0),
        F.least(F.lit(1.0), F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)),
    )
