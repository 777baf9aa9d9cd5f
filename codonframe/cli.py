"""Command line: analyses from files to result tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codonframe.operators import alleles, between, bootstrap, codons, pool, revcom, windows, within
from codonframe.sources import fasta, gtf, tables, variants


def _products(spark, path):
    return gtf.coding_products(gtf.read_gtf(spark, path))


def _checked(a) -> None:
    """Replicates 0 (none) or 2 to 1,000,000, windows of at least 2 codons by at least 1."""
    if not (a.num_bootstraps == 0 or 2 <= a.num_bootstraps <= 1_000_000):
        raise SystemExit("--num_bootstraps must be 0, or from 2 to 1000000")
    if a.sliding_window_size < 2 or a.sliding_window_step < 1:
        raise SystemExit("--sliding_window_size must be at least 2, --sliding_window_step at least 1")


def run_within(spark, a) -> None:
    _checked(a)
    seqs = codons.validated(fasta.read_fasta(spark, a.fasta))
    counts = codons.codon_counts(codons.codon_columns(seqs, _products(spark, a.gtf)))
    found = within.within_codon(counts)
    products = within.product_results(found)
    by = ("group", "product")
    slices = windows.with_excess_flag(windows.sliding_windows(found, a.sliding_window_size, a.sliding_window_step, by), products, by)
    if a.num_bootstraps:
        reps = bootstrap.replicates(found, a.num_bootstraps, a.seed, by)
        tables.write_tsv(reps, f"{a.out}/bootstrap_results")
        products = bootstrap.with_p_values(bootstrap.with_z_test(products, bootstrap.standard_errors(reps, by), by), a.ratio_null)
        slices = bootstrap.window_tests(found, slices, a.num_bootstraps, a.seed, by)
    tables.write_tsv(found, f"{a.out}/within_group_codon_results")
    tables.write_tsv(alleles.variant_results(counts), f"{a.out}/within_group_variant_results")
    tables.write_tsv(alleles.site_diversity(alleles.site_counts(seqs)), f"{a.out}/within_group_site_results")
    tables.write_tsv(products, f"{a.out}/within_group_product_results")
    tables.write_tsv(slices, f"{a.out}/within_group_sliding_window_results")
    tables.write_tsv(windows.window_log(found, a.sliding_window_size, by), f"{a.out}/log")
    within.totals(found).show(truncate=False)


def run_between(spark, a) -> None:
    _checked(a)
    seqs = codons.validated(fasta.read_fasta(spark, a.fasta))
    found = between.between_codon(codons.codon_counts(codons.codon_columns(seqs, _products(spark, a.gtf))))
    by = ("product", "group_1", "group_2")
    least = a.codon_min_taxa_total, a.codon_min_taxa_group
    keep = between.enough_taxa(*least)
    products = between.with_jukes_cantor(between.between_product(found, *least))
    slices = between.with_jukes_cantor(windows.between_windows(found, a.sliding_window_size, a.sliding_window_step, *least))
    slices = windows.with_excess_flag(slices, products, by)
    if a.num_bootstraps:
        reps = bootstrap.replicates(found, a.num_bootstraps, a.seed, by, keep=keep)
        tables.write_tsv(reps, f"{a.out}/bootstrap_results")
        products = bootstrap.with_z_test(products, bootstrap.standard_errors(reps, by, jukes_cantor=True), by)
        slices = bootstrap.window_tests(found, slices, a.num_bootstraps, a.seed, by, keep=keep)
    tables.write_tsv(found, f"{a.out}/between_group_codon_results")
    tables.write_tsv(between.polymorphism_vectors(found), f"{a.out}/between_group_polymorphism")
    tables.write_tsv(products, f"{a.out}/between_group_product_results")
    tables.write_tsv(slices, f"{a.out}/between_group_sliding_window_results")
    tables.write_tsv(windows.window_log(found, a.sliding_window_size, by), f"{a.out}/log")


def run_windows(spark, a) -> None:
    """Windows of rows of a codon table, on the table's own rows and columns."""
    _checked(a)
    df = tables.read_codon_results(spark, a.codon_file)
    by = tuple(c for c in ("file", "group", "product", "group_1", "group_2", "strand") if c in df.columns)
    numbers = {f"{x}_{m}" for x in (a.numerator, a.denominator) for m in ("diffs", "sites")}
    windows.required(df, "codon_num", "num_defined_seqs", *sorted(numbers))
    log = windows.window_log(df, a.sliding_window_size, by, a.min_defined_codons)
    tables.write_tsv(log, f"{a.out}/log")
    guards = windows.table_guards(df, by)
    if guards.head(1):
        tables.write_tsv(guards, f"{a.out}/guards")
        raise SystemExit(f"{a.codon_file} has codon numbers twice, or rows without one: see {a.out}/guards")
    if a.num_bootstraps:
        found = bootstrap.row_window_tests(df, a.sliding_window_size, a.num_bootstraps, a.seed, a.sliding_window_step, a.min_defined_codons, a.numerator, a.denominator, a.jukes_cantor, a.ratio_null, by)
    else:
        found = windows.row_windows(df, a.sliding_window_size, a.sliding_window_step, a.min_defined_codons, a.numerator, a.denominator, by)
    tables.write_tsv(windows.on_rows(df, found, by), f"{a.out}/sliding_windows_d{a.numerator}d{a.denominator}_WINDOWS_")


def _pool_strand(spark, a, found, segments, reference, size, strand) -> None:
    """The result files of the products of one strand; those of the other are analysed in its own coordinates."""
    out = a.out if strand == "+" else f"{a.out}/minus_strand"
    if strand == "-":
        found, reference, segments = variants.revcom_variants(found, size), revcom.revcom_sequences(reference.withColumnRenamed("chrom", "header")), revcom.revcom_segments(segments, size)
    own = segments.where(F.col("strand") == "+")
    cds, every, letters = gtf.cds_sites(own), gtf.both_strands(segments, size), pool.reference_at(reference, own)
    sites, codon_results = pool.pool_sites(found, cds, letters, every), pool.pool_codons(found, cds, letters, every)
    tagged = lambda df: df.withColumn("strand", F.lit(strand))
    tables.write_tsv(tagged(sites).orderBy(F.col("product") == "noncoding", "product", "site"), f"{out}/site_results")
    tables.write_tsv(tagged(codon_results), f"{out}/codon_results")
    tables.write_tsv(tagged(pool.pool_products(codon_results, sites)), f"{out}/product_results")
    tables.write_tsv(tagged(pool.pool_population(codon_results, sites, cds, reference)), f"{out}/population_summary")
    tables.write_tsv(tagged(windows.sliding_windows(codon_results, a.slidingwindow, 1, ("file", "product"))), f"{out}/sliding_window_length{a.slidingwindow}_results")


def run_pool(spark, a) -> None:
    read = {"clc": variants.read_clc, "geneious": variants.read_geneious, "vcf": lambda s, p: variants.read_vcf(s, p, a.vcfformat)}[a.report]
    report = read(spark, a.snpreport)
    found = variants.minimum_frequency(variants.merged(report), a.minfreq)
    reference, segments = fasta.read_reference(spark, a.fasta), gtf.read_gtf(spark, a.gtf, None)
    size = reference.select(F.length("seq")).first()[0]
    strands = [r[0] for r in segments.select("strand").distinct().collect()]  # + and -
    for strand in ["+", *(s for s in strands if s == "-")]:
        _pool_strand(spark, a, found, segments, reference, size, strand)
    tables.write_tsv(pool.warnings(report, a.minfreq), f"{a.out}/log")
    tables.write_tsv(spark.createDataFrame(sorted((k, str(v)) for k, v in vars(a).items() if k != "run"), "parameter string, value string"), f"{a.out}/parameters")


def run_revcom(spark, a) -> None:
    seqs = fasta.read_fasta(spark, a.fasta)
    fasta.write_fasta(revcom.revcom_sequences(seqs), f"{a.out}/fasta")
    size = seqs.agg(F.max(F.length("seq"))).first()[0]
    if a.gtf:
        gtf.write_gtf(revcom.revcom_segments(gtf.read_gtf(spark, a.gtf, None), size), f"{a.out}/gtf")
    if a.vcf:
        rows, head, names = variants.read_vcf_lines(spark, a.vcf)
        variants.write_vcf(revcom.revcom_vcf(rows, size, a.legacy_alt_order), f"{a.out}/vcf", head, names)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codonframe", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name, run, *needed):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        p.add_argument("--out", required=True)
        return p

    def resampled(p):
        p.add_argument("--num_bootstraps", type=int, default=0)
        p.add_argument("--seed", type=int, default=1)
        p.add_argument("--sliding_window_size", type=int, default=9)
        p.add_argument("--sliding_window_step", type=int, default=1)
        p.add_argument("--ratio_null", type=float, default=0.0)

    for name, run in (("within", run_within), ("between", run_between)):
        p = command(name, run, "fasta", "gtf")
        resampled(p)
        p.add_argument("--codon_min_taxa_total", type=int, default=0)
        p.add_argument("--codon_min_taxa_group", type=int, default=0)
    p = command("windows", run_windows, "codon_file")
    resampled(p)
    p.add_argument("--min_defined_codons", type=int, default=2)
    p.add_argument("--jukes_cantor", action="store_true")
    p.add_argument("--numerator", choices=("N", "T"), default="N")
    p.add_argument("--denominator", choices=("S", "N"), default="S")
    p = command("pool", run_pool, "snpreport", "fasta", "gtf")
    p.add_argument("--report", choices=("clc", "geneious", "vcf"), default="clc")
    p.add_argument("--vcfformat", type=int, default=4)
    p.add_argument("--minfreq", type=float, default=0.0)
    p.add_argument("--slidingwindow", type=int, default=9)
    p = command("revcom", run_revcom, "fasta")
    p.add_argument("--gtf")
    p.add_argument("--vcf")
    p.add_argument("--legacy_alt_order", action="store_true")
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("codonframe").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
