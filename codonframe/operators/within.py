"""Diversity within a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonframe.functions.stats import ratio
from codonframe.genetics.code import with_differences

from .codons import KEY, places

MEASURES = ("N_sites", "S_sites", "N_diffs", "S_diffs")


def within_codon(counts: DataFrame) -> DataFrame:
    """A row for each codon place: variability, num_defined_seqs, comparisons, and the four measures.

    Pairs are formed inside a place's row, between its distinct codons, and weighted by their counts;
    the sums over them need no shuffle of their own.
    """
    a = F.col("alleles")
    pairs = F.flatten(F.transform(a, lambda x, i: F.transform(F.slice(a, i + 2, F.size(a)), lambda y: F.struct(x["codon"].alias("a"), y["codon"].alias("b"), (x["cnt"] * y["cnt"]).alias("w")))))
    rows = places(counts).withColumn("_pairs", pairs).withColumn("comparisons", F.transform("_pairs", lambda p: F.concat_ws("-", p["a"], p["b"])))
    held = ["num_defined", "alleles", "comparisons", "N_sites", "S_sites"]
    rows = rows.select(*KEY, *held, F.explode_outer("_pairs").alias("_p")).select(*KEY, *held, F.col("_p.a").alias("_x"), F.col("_p.b").alias("_y"), F.col("_p.w").alias("_w"))
    sums = with_differences(rows, "_x", "_y").groupBy(*KEY).agg(*[F.first(c).alias(c) for c in held], F.sum(F.col("_w") * F.col("n_diff")).alias("_nd"), F.sum(F.col("_w") * F.col("s_diff")).alias("_sd"))
    of_pairs = F.col("num_defined").cast("double") * (F.col("num_defined") - 1) / 2
    mean = lambda c: F.coalesce(F.try_divide(F.col(c), of_pairs), F.lit(0.0))
    return sums.select(
        *KEY, F.when(F.size("alleles") > 1, "polymorphic").otherwise("conserved").alias("variability"), F.col("num_defined").alias("num_defined_seqs"),
        "comparisons", "N_sites", "S_sites", mean("_nd").alias("N_diffs"), mean("_sd").alias("S_diffs"),
    )


def rates(df: DataFrame, undefined_as_zero: bool = False) -> DataFrame:
    """``df`` with dN, dS, their difference and their ratio, null where undefined."""
    dn, ds = ratio(F.col("N_diffs"), F.col("N_sites"), undefined_as_zero), ratio(F.col("S_diffs"), F.col("S_sites"), undefined_as_zero)
    return df.withColumns({"dN": dn, "dS": ds}).withColumns({"dN_minus_dS": F.col("dN") - F.col("dS"), "dN_over_dS": ratio(F.col("dN"), F.col("dS"))})


def totals(codon_results: DataFrame, *by: str) -> DataFrame:
    """Sums of the four measures, by columns or over everything."""
    return codon_results.groupBy(*by).agg(*[F.sum(m).alias(m) for m in MEASURES])


def product_results(codon_results: DataFrame, undefined_as_zero: bool = False) -> DataFrame:
    """Sums and rates of each group and product."""
    return rates(totals(codon_results, "group", "product"), undefined_as_zero)
