"""Array expressions over doubles: dot product, norm, normalisation, periodic shift, clipping, grids, angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """The vector divided by its norm; null elements where the norm is 0."""
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, n))


def roll(a: Column, by: int) -> Column:
    """Periodic shift: the element at i moves to i + by."""
    n = F.size(a)
    k = F.pmod(F.lit(by), n)
    return F.when(n == 0, a).otherwise(F.concat(F.slice(a, n - k + 1, k), F.slice(a, F.lit(1), n - k)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def linspace(low: float, high: float, n: int) -> Column:
    """n equally spaced numbers from low to high, both included."""
    step = (high - low) / (n - 1) if n > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * F.lit(step))


def angle(a: Column, b: Column) -> Column:
    """Angle in degrees, at most 90, between the lines of two unit vectors."""
    return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dot(a, b)))))


def state_columns(names: list[str]) -> list[str]:
    """Columns of a state by their prefix: x... or PC..."""
    return [c for c in names if c.startswith(("x", "PC"))]
