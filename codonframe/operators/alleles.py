"""Codon variants and nucleotide sites of an alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonframe.functions.sequence import translated

from . import pieces
from .codons import KEY

BASES = ("A", "C", "G", "T")


def variant_type(amino_acids: Column) -> Column:
    """Synonymous where all alleles give one amino acid, Nonsynonymous where each gives its own, else Ambiguous."""
    kinds = F.size(F.array_distinct(amino_acids))
    return F.when(kinds == 1, "Synonymous").when(kinds == F.size(amino_acids), "Nonsynonymous").otherwise("Ambiguous")


def variant_results(counts: DataFrame) -> DataFrame:
    """A row for each polymorphic codon place: alleles in alphabetical order with their counts, the consensus, the kind of variant."""
    # No filter on the codon: it would be pushed below the count, where the codon is made.
    here = F.when(F.col("codon").isNotNull(), F.struct("codon", "cnt"))
    held = counts.groupBy(*KEY).agg(F.array_sort(F.collect_list(here)).alias("_a"), F.sum(here["cnt"]).alias("num_defined_seqs"), F.max(here["cnt"]).alias("max_codon_count"), F.count("codon").alias("num_alleles"))
    held = held.where(F.col("num_alleles") > 1)
    part = lambda name: F.transform("_a", lambda x: x[name])
    acids = F.transform("_a", lambda x: translated(x["codon"]))
    consensus = F.filter("_a", lambda x: x["cnt"] == F.col("max_codon_count"))[0]["codon"]  # the first in the alphabet of several
    return held.select(
        *KEY, consensus.alias("consensus_codon"), "num_alleles", part("codon").alias("codons"), acids.alias("amino_acids"), variant_type(acids).alias("variant_type"),
        part("cnt").alias("codon_counts"), F.col("num_defined_seqs").alias("count_total"),
        F.transform("_a", lambda x: F.round(x["cnt"] / F.col("num_defined_seqs"), 3)).alias("codon_freqs"),
        "max_codon_count", (F.col("num_defined_seqs") - F.col("max_codon_count")).alias("min_codon_count"), "num_defined_seqs",
    )


def minor_count_histogram(variants: DataFrame) -> DataFrame:
    return variants.groupBy("min_codon_count", "num_alleles").agg(F.count("*").alias("places"))


def site_counts(seqs: DataFrame) -> DataFrame:
    """group, site, A, C, G, T of an alignment; other letters do not count. Sequences are cut into pieces before they become a row for each base."""
    found = base_counts(pieces.site_rows(pieces.cut(seqs, "group"), ("group",)), "group", "site")
    return found.withColumn("site", F.col("site").cast("int"))


def base_counts(reads: DataFrame, *by: str) -> DataFrame:
    """A, C, G, T by columns, from one row for each letter."""
    return reads.groupBy(*by).agg(*[F.sum((F.col("nt") == b).cast("long")).alias(b) for b in BASES])


def pi_of(counts: list[Column]) -> Column:
    """Share of pairs that differ; null below two reads."""
    n = sum(counts[1:], counts[0]).cast("double")
    differing = sum((counts[i].cast("double") * counts[j] for i in range(4) for j in range(i + 1, 4)), F.lit(0.0))
    return F.when(n > 1, F.try_divide(differing, n * (n - 1) / 2))


def gene_diversity(counts: list[Column]) -> Column:
    """One less the sum of squared frequencies; null without reads."""
    n = sum(counts[1:], counts[0]).cast("double")
    return F.when(n > 0, 1 - sum((F.pow(F.try_divide(c.cast("double"), n), F.lit(2.0)) for c in counts[1:]), F.pow(F.try_divide(counts[0].cast("double"), n), F.lit(2.0))))


def majority(counts: list[Column]) -> Column:
    """The most frequent base; the first in the order A, C, G, T of several."""
    most = F.greatest(*counts)
    found = F.lit("T")
    for b, c in reversed(list(zip(BASES[:3], counts[:3]))):
        found = F.when(c == most, b).otherwise(found)
    return found


def site_diversity(counts: DataFrame) -> DataFrame:
    """``counts`` with coverage, maj_nt, maj_nt_count and pi."""
    bases = [F.col(b) for b in BASES]
    return counts.withColumns({"coverage": sum(bases[1:], bases[0]), "maj_nt": majority(bases), "maj_nt_count": F.greatest(*bases), "pi": pi_of(bases)})
