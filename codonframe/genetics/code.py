"""Codon tables, generated from the standard genetic code.

``codon_dim`` has 64 rows, ``codon_pair_dim`` 4,096: both are of fixed size, so
joins with them may always be broadcast.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = "ACGT"
# Amino acids of the 64 codons in the order AAA, AAC, AAG, AAT, ACA ... TTT; * is a stop.
AMINO_ACIDS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"
CODONS = [a + b + c for a in BASES for b in BASES for c in BASES]
CODE = dict(zip(CODONS, AMINO_ACIDS))
STOP = "*"


def site_counts(codon: str) -> list[tuple[float, float]]:
    """(nonsynonymous, synonymous) sites of each position; changes to a stop do not count, and a stop has none."""
    if CODE[codon] == STOP:
        return [(0.0, 0.0)] * 3
    found = []
    for p in range(3):
        reached = [CODE[codon[:p] + b + codon[p + 1 :]] for b in BASES if b != codon[p]]
        sense = [a for a in reached if a != STOP]
        other = sum(a != CODE[codon] for a in sense)
        found.append((other / len(sense), (len(sense) - other) / len(sense)) if sense else (0.0, 0.0))
    return found


def pair_differences(one: str, two: str) -> tuple[float, float]:
    """(nonsynonymous, synonymous) differences, a mean over the orders of change that pass no stop; 0 if either is a stop."""
    if STOP in (CODE[one], CODE[two]):
        return 0.0, 0.0
    places = [p for p in range(3) if one[p] != two[p]]
    paths = []
    for order in permutations(places):
        now, n = one, 0
        for p in order:
            then = now[:p] + two[p] + now[p + 1 :]
            if CODE[then] == STOP:
                break
            n, now = n + (CODE[then] != CODE[now]), then
        else:
            paths.append((n, len(places) - n))
    if not paths:
        return 0.0, 0.0
    return sum(n for n, _ in paths) / len(paths), sum(s for _, s in paths) / len(paths)


@lru_cache(maxsize=1)
def _tables() -> tuple[list[tuple], list[tuple]]:
    singles = []
    for codon in CODONS:
        sites = site_counts(codon)
        flat = [x for pair in sites for x in pair]
        singles.append((codon, CODE[codon], *flat, sum(n for n, _ in sites), sum(s for _, s in sites)))
    return singles, [(a, b, *pair_differences(a, b)) for a in CODONS for b in CODONS]


def codon_dim(spark: SparkSession) -> DataFrame:
    """codon, aa, n1, s1, n2, s2, n3, s3, n_sites, s_sites."""
    return spark.createDataFrame(_tables()[0], "codon string, aa string, n1 double, s1 double, n2 double, s2 double, n3 double, s3 double, n_sites double, s_sites double")


def codon_pair_dim(spark: SparkSession) -> DataFrame:
    """codon_a, codon_b, n_diff, s_diff for all ordered pairs."""
    return spark.createDataFrame(_tables()[1], "codon_a string, codon_b string, n_diff double, s_diff double")


def with_sites(df: DataFrame, column: str = "codon", prefix: str = "") -> DataFrame:
    """``df`` with aa, n_sites and s_sites of a codon column; null where the codon is unknown."""
    dim = codon_dim(df.sparkSession).select(F.col("codon").alias(column), *[F.col(c).alias(prefix + c) for c in ("aa", "n_sites", "s_sites")])
    return df.join(F.broadcast(dim), column, "left")


def with_differences(df: DataFrame, one: str, two: str) -> DataFrame:
    """``df`` with n_diff and s_diff of two codon columns; 0 where either is unknown."""
    dim = codon_pair_dim(df.sparkSession).select(F.col("codon_a").alias(one), F.col("codon_b").alias(two), "n_diff", "s_diff")
    joined = df.join(F.broadcast(dim), [one, two], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("n_diff", "s_diff")})
