"""Null-safe arithmetic with the semantics of missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or either is null."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def floor_at(x: Column, least: float) -> Column:
    """max(x, least), null where x is null (``greatest`` alone would skip the null)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def flag(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def log_performance(x: Column, least: float = 0.01) -> Column:
    return F.ln(floor_at(x, least))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p of a standard normal, by the Abramowitz-Stegun 7.1.26 fit of erf (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def round_half_even(x: Column, digits: int) -> Column:
    """x at so many places, halves of the binary value to even: 2.675 is less than it looks and gives 2.67.

    The product with the power of ten is taken with its rounding error (Dekker's
    split), so a product that only looks like a half is told from one that is.
    """
    scale = 10.0**digits
    # both factors in halves of 26 bits, whose products are exact
    split = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    high_scale = scale * 134217729.0 - (scale * 134217729.0 - scale)
    low_scale = scale - high_scale
    product = x * scale
    high = split(x)
    low = x - high
    error = ((high * high_scale - product) + high * low_scale + low * high_scale) + low * low_scale
    below = F.floor(product).cast("double")
    rest = product - below
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (F.pmod(below, F.lit(2.0)) == 1))))
    rounded = (below + up.cast("double")) / scale
    # beyond 2^52 a product has no places left
    return F.when(F.abs(product) < 4503599627370496.0, rounded).otherwise(x)
