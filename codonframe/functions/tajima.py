"""Tajima's D and its significance.

The critical values are quantiles of a beta distribution rescaled to the range D
can take (Tajima 1989), computed here for the sample sizes of the usual table.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (0.001, 0.01, 0.05, 0.1)
# The sample sizes at which the critical values change.
SIZES = [*range(4, 51), *range(55, 101, 5), *range(110, 151, 10), 175, *range(200, 501, 50), 600, 800, 1000]


#: From this number of terms on the sums are taken from their expansions, whose error is below 1e-14 there.
EXPANDED = 32


def harmonic(m: Column) -> tuple[Column, Column]:
    """Sums of 1/i and of 1/i^2 for i from 1 to ``m``, without a step for each term."""
    x = F.greatest(m.cast("double"), F.lit(float(EXPANDED)))
    long = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    squares = math.pi**2 / 6 - 1 / x + 1 / (2 * x**2) - 1 / (6 * x**3) + 1 / (30 * x**5) - 1 / (42 * x**7)
    first = lambda power: F.get(F.array(*[F.lit(sum(1 / i**power for i in range(1, k + 1))) for k in range(EXPANDED)]), F.greatest(m.cast("int"), F.lit(0)))
    return F.when(m < EXPANDED, first(1)).otherwise(long), F.when(m < EXPANDED, first(2)).otherwise(squares)


def tajima_d(n: Column, segregating: Column, pi: Column) -> Column:
    """D of ``n`` sequences with ``segregating`` sites and ``pi`` mean pairwise differences; null below two sequences or without sites."""
    a1, a2 = harmonic(F.greatest(n.cast("long") - 1, F.lit(1)))
    m, s = n.cast("double"), segregating.cast("double")
    b1, b2 = (m + 1) / (3 * (m - 1)), 2 * (m * m + m + 3) / (9 * m * (m - 1))
    e1, e2 = (b1 - 1 / a1) / a1, (b2 - (m + 2) / (a1 * m) + a2 / (a1 * a1)) / (a1 * a1 + a2)
    variance = e1 * s + e2 * s * (s - 1)
    return F.when((n >= 2) & (variance > 0), (pi - s / a1) / F.sqrt(variance))


def tajima_sites(sites: DataFrame, *by: str) -> DataFrame:
    """``by``, n, S, pi, D from ``site_diversity`` rows: the most reads at a site, the sites with more than one base, and their pairwise differences added up."""
    present = sum(((F.col(b) > 0).cast("int") for b in "CGT"), (F.col("A") > 0).cast("int"))
    found = sites.groupBy(*by).agg(F.max("coverage").cast("long").alias("n"), F.count_if(present > 1).alias("S"), F.coalesce(F.sum("pi"), F.lit(0.0)).alias("pi"))
    return found.withColumn("D", tajima_d(F.col("n"), F.col("S"), F.col("pi")))


def _range(n: int) -> tuple[float, float]:
    """Least and greatest D as the number of sites grows."""
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    b2 = 2 * (n * n + n + 3) / (9 * n * (n - 1))
    e2 = (b2 - (n + 2) / (a1 * n) + a2 / a1**2) / (a1**2 + a2)
    high = (n / (2 * (n - 1)) if n % 2 == 0 else (n + 1) / (2 * n)) - 1 / a1
    return (2 / n - 1 / a1) / math.sqrt(e2), high / math.sqrt(e2)


def _beta_below(x: float, p: float, q: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (p + 1) / (p + q + 2):
        return 1 - _beta_below(1 - x, q, p)
    front = math.exp(math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) + p * math.log(x) + q * math.log1p(-x)) / p
    c, d = 1.0, 1 / max(1 - (p + q) * x / (p + 1), 1e-30)
    value = d
    for m in range(1, 500):
        for term in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / (1 + term * d if abs(1 + term * d) > 1e-30 else 1e-30)
            c = 1 + term / c if abs(1 + term / c) > 1e-30 else 1e-30
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def _quantile(share: float, p: float, q: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_below(mid, p, q) < share else (low, mid)
    return (low + high) / 2


@lru_cache(maxsize=1)
def critical_values() -> list[tuple[int, float, float, float]]:
    """(n, level, lower, upper) for each size and level."""
    found = []
    for n in SIZES:
        a, b = _range(n)
        # The density at D is (D - a)^(p - 1) (b - D)^(q - 1) up to a factor.
        p, q = abs((1 + a * b) * a / (b - a)), abs((1 + a * b) * b / (b - a))
        for level in LEVELS:
            found.append((n, level, a + (b - a) * _quantile(level / 2, p, q), a + (b - a) * _quantile(1 - level / 2, p, q)))
    return found


def with_significance(df: DataFrame, n_col: str = "n", d_col: str = "D") -> DataFrame:
    """``df`` with significance: the strictest level whose bounds D reaches, as text, or ``n.s.``

    The bounds are those of the largest tabled size not above n; there are fewer
    than 100 sizes, so the table is broadcast.
    """
    by_size: dict[int, list[float]] = {}
    for n, _, low, high in critical_values():
        by_size.setdefault(n, []).extend((low, high))
    dim = df.sparkSession.createDataFrame([(n, v) for n, v in by_size.items()], "_size int, _bounds array<double>")
    sizes = F.array(*[F.lit(n) for n in SIZES])
    size = F.array_max(F.filter(sizes, lambda x: x <= F.col(n_col)))
    found = F.lit("n.s.")
    for i, level in reversed(list(enumerate(LEVELS))):
        found = F.when((F.col(d_col) <= F.col("_bounds")[2 * i]) | (F.col(d_col) >= F.col("_bounds")[2 * i + 1]), str(level)).otherwise(found)
    joined = df.withColumn("_size", size).join(F.broadcast(dim), "_size", "left")
    return joined.withColumn("significance", F.when(F.col("_bounds").isNull(), "n.s.").otherwise(found)).drop("_size", "_bounds")
