"""Coefficients of a spectral model from its wave modes: triads, tendencies and orographic terms, as DataFrame steps.

A mode (m, n) is sqrt2 cos(n y / b) for m = 0 and sqrt2 exp(i m x) sin(n y / b) otherwise, on x in [0, 2 pi] and
y in [0, b pi]. The triad integral of mode j with the Jacobian of modes k and l is i times a real number c:
over x it is 2 pi if the zonal wavenumbers sum to 0, else nothing; over y it is a sum over the signs of the three
waves' exponentials. Real modes are combinations of modes (m, n) and (-m, n).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIX_X, TEN_X, Y_MODES = (-1, 0, 1), (-2, -1, 0, 1, 2), (1, 2)


def mode_table(spark: SparkSession, x_modes: Sequence[int] = SIX_X, y_modes: Sequence[int] = Y_MODES) -> DataFrame:
    """(m, n) of all modes."""
    return spark.createDataFrame([(m, n) for m in x_modes for n in y_modes], "m int, n int")


def real_modes(spark: SparkSession, b: float, x_modes: Sequence[int] = SIX_X, y_modes: Sequence[int] = Y_MODES, scaled: bool = True) -> DataFrame:
    """(id, m, n, re, im): the real modes x_1.. as combinations of modes, the zonal one, the cosine and the sine of each
    wavenumber; with `scaled` by 1 / b. Ids go by meridional wavenumber, the higher zonal wavenumbers last."""
    f, half, rows, at = (1 / b if scaled else 1.0), 1 / math.sqrt(2), [], 0
    for first in (True, False):
        for n in y_modes:
            if first:
                at += 1
                rows.append((at, 0, n, f, 0.0))
            for m in sorted({abs(x) for x in x_modes if x and (abs(x) == 1) == first}):
                rows += [(at + 1, -m, n, half * f, 0.0), (at + 1, m, n, half * f, 0.0), (at + 2, -m, n, 0.0, -half * f), (at + 2, m, n, 0.0, half * f)]
                at += 2
    return spark.createDataFrame(rows, "id int, m int, n int, re double, im double")


def _wave(name: str) -> tuple[Column, Column]:
    return F.col(f"{name}x"), F.col(f"{name}y")


def _integral(sines: Sequence[Column], numbers: Sequence[Column]) -> Column:
    """Integral over [0, pi] of the product of three waves sin(n t) (where `sines` is 1) or cos(n t) (0)."""
    count = sines[0] + sines[1] + sines[2]
    total = F.lit(0.0)
    for bits in range(8):
        signs = [1 if bits >> k & 1 else -1 for k in range(3)]
        p = sum((n * s for n, s in zip(numbers, signs)), F.lit(0))
        weight = F.lit(1.0)
        for sine, s in zip(sines, signs):
            weight = weight * F.when(sine == 1, F.lit(float(s))).otherwise(F.lit(1.0))
        # exp(i p t) gives pi for p = 0, and i (1 - (-1)^p) / p otherwise; of it the part that i^-count makes real
        even = F.when(p == 0, F.lit(math.pi)).otherwise(F.lit(0.0))
        odd = F.when(p == 0, F.lit(0.0)).otherwise(F.try_divide(F.when(p % 2 == 0, F.lit(0.0)).otherwise(F.lit(2.0)), p))
        total = total + weight * F.when(count % 2 == 0, even).otherwise(odd)
    # i^-count: 1, -i, -1, i; an odd count leaves i * (-i) = 1 or i * i = -1
    phase = F.when(count.isin(0, 1), F.lit(1.0)).otherwise(F.lit(-1.0))
    return phase * total / 8.0


def triads(modes: DataFrame, b: float) -> DataFrame:
    """(jx, jy, kx, ky, lx, ly, c): the triads that don't vanish; the integral over 4 pi^2 is i * c."""
    j, k, l = (modes.select(F.col("m").alias(f"{x}x"), F.col("n").alias(f"{x}y")) for x in "jkl")
    wave = (F.col("jx") + F.col("kx") + F.col("lx") == 0) & ~((F.col("kx") == 0) & (F.col("lx") == 0))
    # a wavenumber fixes the third, so this is an equi-join; the mode tables are a model's, ten rows at most
    rows = F.broadcast(j).join(F.broadcast(k)).join(l, F.col("lx") == -(F.col("jx") + F.col("kx"))).filter(wave)
    sine = lambda x: F.when(F.col(f"{x}x") == 0, 0).otherwise(1)

    def term(deriv_x: str, deriv_y: str) -> Column:
        """One product of the Jacobian: i * m of one wave, d/dy of the other."""
        m, n, is_sine = F.col(f"{deriv_x}x"), F.col(f"{deriv_y}y"), sine(deriv_y)
        slope = F.when(is_sine == 1, n / F.lit(b)).otherwise(-n / F.lit(b))
        sines = [sine("j"), sine("k"), sine("l")]
        sines["jkl".index(deriv_y)] = 1 - is_sine
        return m * slope * _integral(sines, [F.col("jy"), F.col("ky"), F.col("ly")])

    root = 2 * math.sqrt(2)
    value = (term("k", "l") - term("l", "k")) * F.lit(root * 2 * math.pi * b / (4 * math.pi**2))
    return rows.withColumn("c", value).filter(F.abs("c") > 1e-12).select("jx", "jy", "kx", "ky", "lx", "ly", "c")


def laplacian(x: str, b: float) -> Column:
    m, n = _wave(x)
    return m * m + (n / F.lit(b)) * (n / F.lit(b))


def real_terms(tri: DataFrame, real: DataFrame, scale: Column, height: dict[int, float] | None = None) -> DataFrame:
    """(j, k, l, v): terms v x_k x_l of the tendency of x_j; with `height` (by l) of orography, v x_k.

    Only triads of three different modes take part. `scale` multiplies each triad's number."""
    pick = {x: real.select(F.col("id").alias(x), F.col("m").alias(f"{x}x"), F.col("n").alias(f"{x}y"), F.col("re").alias(f"{x}re"), F.col("im").alias(f"{x}im")) for x in "jkl"}
    rows = tri.withColumn("c", F.col("c") * scale)
    for x in "jkl":
        rows = rows.join(F.broadcast(pick[x]), [f"{x}x", f"{x}y"])
    differ = lambda x, y: (F.col(f"{x}x") != F.col(f"{y}x")) | (F.col(f"{x}y") != F.col(f"{y}y"))
    rows = rows.filter(differ("j", "k") & differ("k", "l") & differ("j", "l"))
    a, b_, c, d, e, f = (F.col(n) for n in ("jre", "jim", "kre", "kim", "lre", "lim"))
    # real part of i * c times the product of the three complex weights, that is minus its imaginary part
    imaginary = (a * d + b_ * c) * e + (a * c - b_ * d) * f
    value = -F.col("c") * imaginary
    if height is not None:
        pairs = [F.lit(x) for p in height.items() for x in p] or [F.lit(-1), F.lit(0.0)]
        value = value * F.coalesce(F.create_map(*pairs)[F.col("l")], F.lit(0.0))
    return rows.groupBy("j", "k", "l").agg(F.sum(value).alias("v")).filter(F.abs("v") > 1e-12)


def nonlinear_terms(tri: DataFrame, real: DataFrame, b: float) -> DataFrame:
    """(j, k, l, v) with k < l: terms of x_k x_l and x_l x_k together."""
    terms = real_terms(tri, real, laplacian("l", b) / laplacian("j", b))
    both = terms.groupBy("j", F.least("k", "l").alias("k"), F.greatest("k", "l").alias("l")).agg(F.sum("v").alias("v"))
    return both.filter(F.abs("v") > 1e-12)


def orographic_terms(tri: DataFrame, real: DataFrame, b: float, gamma: float = 1.0, height: dict[int, float] | None = None) -> DataFrame:
    """(j, k, v): terms v x_k of the tendency of x_j for orography of these heights (by real mode)."""
    terms = real_terms(tri, real, F.lit(-gamma) / laplacian("j", b), height if height is not None else {2: 1 / b})
    return terms.groupBy("j", "k").agg(F.sum("v").alias("v")).filter(F.abs("v") > 1e-12)
