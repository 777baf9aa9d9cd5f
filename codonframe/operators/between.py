"""Divergence between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonframe.functions.stats import jukes_cantor, ratio
from codonframe.genetics.code import with_differences, with_sites

from .codons import places
from .within import MEASURES, rates

PAIR = ("product", "group_1", "group_2")


def group_pairs(counts: DataFrame) -> DataFrame:
    """group_1 < group_2: every pair of groups once, names in order."""
    groups = counts.select("group").distinct()
    return groups.withColumnRenamed("group", "group_1").join(groups.withColumnRenamed("group", "group_2"), F.col("group_1") < F.col("group_2"))


def between_codon(counts: DataFrame) -> DataFrame:
    """A row for each codon place and pair of groups: variability, defined codons of both, the four measures.

    Where one group has no defined codon, the other's least codon gives the
    sites and there is no difference.
    """
    least = places(counts).withColumn("_least", F.get("alleles", F.lit(0))["codon"])
    per_group = with_sites(least, "_least", "least_")
    side = lambda i: per_group.select("product", "codon_num", F.col("group").alias(f"group_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in ("num_defined", "alleles", "N_sites", "S_sites", "least_n_sites", "least_s_sites")])
    both = side(1).join(side(2), ["product", "codon_num"]).where(F.col("group_1") < F.col("group_2"))
    unlike = F.flatten(F.transform("alleles_1", lambda x: F.transform(F.filter("alleles_2", lambda y: y["codon"] != x["codon"]), lambda y: F.struct(x["codon"].alias("a"), y["codon"].alias("b"), (x["cnt"] * y["cnt"]).alias("w")))))
    compared = (F.col("num_defined_1") > 0) & (F.col("num_defined_2") > 0)
    same = (F.size("alleles_1") == 1) & (F.size("alleles_2") == 1) & (F.get("alleles_1", F.lit(0))["codon"] == F.get("alleles_2", F.lit(0))["codon"])

    def sites(kind: str, lone: str) -> Column:
        of_one = F.coalesce(F.col(f"{lone}_1"), F.col(f"{lone}_2"), F.lit(0.0))
        return F.when(compared, (F.col(f"{kind}_1") + F.col(f"{kind}_2")) / 2).otherwise(of_one).alias(kind)

    place = ["product", "codon_num", "group_1", "group_2"]
    held = ["variability", "num_defined_1", "num_defined_2", "N_sites", "S_sites"]
    rows = both.select(
        *place, F.when(compared & ~same, "polymorphic").otherwise("conserved").alias("variability"), "num_defined_1", "num_defined_2",
        sites("N_sites", "least_n_sites"), sites("S_sites", "least_s_sites"), F.explode_outer(unlike).alias("_p"),
    ).select(*place, *held, F.col("_p.a").alias("_x"), F.col("_p.b").alias("_y"), F.col("_p.w").alias("_w"))
    # The join has dealt the rows by place: the sums stay where they are.
    sums = with_differences(rows, "_x", "_y").groupBy(*place).agg(*[F.first(c).alias(c) for c in held], F.sum(F.col("_w") * F.col("n_diff")).alias("_nd"), F.sum(F.col("_w") * F.col("s_diff")).alias("_sd"))
    of_pairs = F.col("num_defined_1").cast("double") * F.col("num_defined_2")
    mean = lambda c: F.coalesce(F.try_divide(F.col(c), of_pairs), F.lit(0.0))
    return sums.select(
        *PAIR, "codon_num", "variability", F.col("num_defined_1").alias("num_defined_codons_g1"), F.col("num_defined_2").alias("num_defined_codons_g2"),
        "N_sites", "S_sites", mean("_nd").alias("N_diffs"), mean("_sd").alias("S_diffs"),
    )


def enough_taxa(min_total: int = 0, min_group: int = 0) -> Column:
    """True where both groups together, and the smaller one, have so many defined codons; 0 asks for nothing."""
    one, two = F.col("num_defined_codons_g1"), F.col("num_defined_codons_g2")
    return (F.lit(min_total == 0) | (one + two >= min_total)) & (F.lit(min_group == 0) | (F.least(one, two) >= min_group))


def between_product(codon_results: DataFrame, min_total: int = 0, min_group: int = 0) -> DataFrame:
    """Sums and rates of each product and pair of groups, over codons with enough taxa."""
    kept = codon_results.where(enough_taxa(min_total, min_group))
    return rates(kept.groupBy(*PAIR).agg(*[F.sum(m).alias(m) for m in MEASURES]))


def with_jukes_cantor(df: DataFrame) -> DataFrame:
    """``df`` (with dN, dS) and the corrected rates, their difference and ratio."""
    found = df.withColumns({"JC_dN": jukes_cantor(F.col("dN")), "JC_dS": jukes_cantor(F.col("dS"))})
    return found.withColumns({"JC_dN_minus_dS": F.col("JC_dN") - F.col("JC_dS"), "JC_dNdS": ratio(F.col("JC_dN"), F.col("JC_dS"))})


def polymorphism_vectors(codon_results: DataFrame) -> DataFrame:
    """The 0/1 vector of each product and pair of groups, in order of codons."""
    here = F.struct("codon_num", (F.col("variability") == "polymorphic").cast("int").alias("p"))
    return codon_results.groupBy(*PAIR).agg(F.array_sort(F.collect_list(here)).alias("_v")).select(*PAIR, F.transform("_v", lambda x: x["p"]).alias("polymorphic"))
