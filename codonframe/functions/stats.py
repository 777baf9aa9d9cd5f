"""Ratios, corrections and tests on numeric columns.

Undefined values are null and stay null; ``undefined_as_zero`` takes them as 0 instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, undefined_as_zero: bool = False) -> Column:
    found = F.when(bottom > 0, top / bottom)
    return F.coalesce(found, F.lit(0.0)) if undefined_as_zero else found


def jukes_cantor(p: Column) -> Column:
    """Distance corrected for several changes at a site; null where p reaches 3/4."""
    return F.when(p < 0.75, -0.75 * F.ln(1 - p * 4 / 3))


def z_score(difference: Column, error: Column) -> Column:
    return F.when(error > 0, difference / error)


def stars(z: Column) -> Column:
    size = F.abs(z)
    return F.when(size > 2.81, "***").when(size > 1.96, "**").when(size > 1.64, "*").when(z.isNotNull(), "")


def erfc(x: Column) -> Column:
    """Complementary error function of values from 0 on, to about 1e-15: one less the series of the error function below 2, a continued fraction beyond."""
    t, series, u, fraction = 2 * x * x, F.lit(1.0), 0.5 / (x * x), F.lit(1.0)
    for n in range(40, 0, -1):
        series = 1 + t / float(2 * n + 1) * series
    for k in range(60, 0, -1):
        fraction = 1 + float(k) * u / fraction
    bell = F.exp(-x * x)
    return F.when(x < 2, 1 - 2 / math.sqrt(math.pi) * bell * x * series).otherwise(bell / (x * math.sqrt(math.pi)) / fraction)


def two_sided_p(z: Column) -> Column:
    """Probability of a standard normal value at least as far from 0; null where z is."""
    return erfc(F.abs(z.cast("double")) / math.sqrt(2))


def ratio_p(value: Column, error: Column, ratio_null: float = 0.0) -> Column:
    """P value of a ratio; ``ratio_null`` is the value under the null hypothesis, 0 or 1."""
    return two_sided_p(z_score(value - ratio_null, error))

