"""Pooled samples: diversity from variant reports.

Derived from the documented definitions. Reads do not say which variants stand
together, so sites of a codon are taken as independent. Pairs at a site are set against each
other with the reference's bases around them. A codon's sites, and its differences from
the reference, are means over its haplotypes, of which three sites make at most 64: each has the
product of its bases' frequencies. ``variable_sites`` says where that was needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codonframe.functions.sequence import translated
from codonframe.functions.stats import ratio
from codonframe.genetics.code import with_differences, with_sites

from . import pieces
from .alleles import BASES, gene_diversity, majority, pi_of, variant_type


def _bases() -> list[Column]:
    return [F.col(b) for b in BASES]


#: Bases cut out of a long sequence together; buckets over which every codon meets every file.
PIECE, BUCKETS = 10_000, 64


def reference_sites(reference: DataFrame) -> DataFrame:
    """site, ref_nt of a reference table (seq). A chromosome is cut into pieces first, which are then dealt over tasks."""
    raw = F.col("seq").cast("binary")
    numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / PIECE).cast("int"))
    cut = reference.select(F.explode(F.transform(numbers, lambda i: F.struct(i.alias("i"), F.substring(raw, i * PIECE + 1, F.lit(PIECE)).cast("string").alias("s")))).alias("_p"))
    letters = cut.repartition("_p.i").select((F.col("_p.i") * PIECE).alias("_before"), F.posexplode(F.split("_p.s", "")).alias("_at", "ref_nt")).where(F.col("ref_nt") != "")
    return letters.select((F.col("_before") + F.col("_at") + 1).alias("site"), "ref_nt")


def reference_at(reference: DataFrame, segments: DataFrame) -> DataFrame:
    """site, ref_nt of a reference table (seq), at the places of ``segments`` alone."""
    return letters_at(pieces.cut(reference), segments)


def letters_at(reference: DataFrame, segments: DataFrame) -> DataFrame:
    """site, ref_nt of a reference in pieces, at the places that ``segments`` (product, strand, start, stop) cover, each once: no row is made of any other base.

    Stretches of places meet the pieces they lie in; a place becomes a row only where its letter is.
    """
    size = pieces.PIECE
    spans = overlap_intervals(segments).select("start", "stop", F.explode(F.sequence(F.floor((F.col("start") - 1) / size).cast("int"), F.floor((F.col("stop") - 1) / size).cast("int"))).alias("piece"))
    before = F.col("piece").cast("long") * size
    lo, hi = F.greatest(F.col("start"), before + 1), F.least(F.col("stop"), before + size)
    met = reference.select("piece", "bases").join(pieces.sent(spans, F.lit(24)), "piece")
    letters = met.select(lo.alias("_lo"), F.posexplode(F.split(F.substring(F.col("bases"), (lo - before).cast("int"), (hi - lo + 1).cast("int")), "")).alias("_at", "ref_nt")).where(F.col("ref_nt") != "")
    return letters.select((F.col("_lo") + F.col("_at")).cast("int").alias("site"), "ref_nt")


def with_every_file(codons: DataFrame, variants: DataFrame) -> DataFrame:
    """Each codon once for each file. Codons are dealt into buckets, and a file meets each of them: no task has all pairs."""
    files = variants.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("_bucket"))
    dealt = codons.withColumn("_bucket", F.pmod(F.xxhash64("product", "codon_num"), F.lit(BUCKETS)).cast("int"))
    return dealt.join(files, "_bucket").drop("_bucket")


def pool_counts(variants: DataFrame) -> DataFrame:
    """file, site, ref_nt, coverage, A, C, G, T: reads of each base; those of no variant are the reference's. May be fractional."""
    seen = [F.sum(F.when(F.col("alt") == b, F.col("count")).otherwise(0.0)).alias(f"_{b}") for b in BASES]
    rows = variants.where(F.col("coverage") > 0).groupBy("file", "site").agg(F.max("ref").alias("ref_nt"), F.max("coverage").alias("coverage"), F.sum("count").alias("_all"), *seen)
    rest = F.greatest(F.col("coverage") - F.col("_all"), F.lit(0.0))
    return rows.select("file", "site", "ref_nt", "coverage", *[(F.col(f"_{b}") + F.when(F.col("ref_nt") == b, rest).otherwise(0.0)).alias(b) for b in BASES])


def with_diversity(counts: DataFrame) -> DataFrame:
    """``counts`` with maj_nt, pi, gdiv and polymorphic (more than one base has reads)."""
    present = sum(((c > 0).cast("int") for c in _bases()[1:]), (_bases()[0] > 0).cast("int"))
    return counts.withColumns({"maj_nt": majority(_bases()), "pi": pi_of(_bases()), "gdiv": gene_diversity(_bases()), "polymorphic": present > 1})


def reference_codons(cds: DataFrame, reference: DataFrame) -> DataFrame:
    """product, codon_num, codon, codon_start_site of the reference, from ``cds_sites`` and (site, ref_nt)."""
    joined = cds.join(reference, "site")
    letters = F.array_sort(F.collect_list(F.struct("position_in_codon", "ref_nt")))
    return joined.groupBy("product", "codon_num").agg(F.array_join(F.transform(letters, lambda x: x["ref_nt"]), "").alias("codon"), F.min("codon_start_site").alias("codon_start_site"))


def overlaps(cds: DataFrame) -> DataFrame:
    """site, overlapping_ORFs: products that cover a site, less one; a product of the other strand is another one."""
    return cds.groupBy("site").agg((F.count_distinct("product", *[c for c in ("strand",) if c in cds.columns]) - 1).alias("overlapping_ORFs"))


#: Places of a block of the sweep.
BLOCK = 1 << 16


def overlap_intervals(segments: DataFrame) -> DataFrame:
    """start, stop, products: stretches of places that equally many products cover, from segments (product, strand, start, stop) in the same coordinates.

    A sweep line: a product's segments, joined where they meet, begin with +1 and end with
    -1, and the running sum is the number of products. The sum runs inside blocks of
    ``BLOCK`` places, over what the blocks before have added up to; so a task sweeps a
    block, and only a row for each block is summed in one.
    """
    own = Window.partitionBy("product", "strand").orderBy("start", "stop")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = segments.select("product", "strand", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop")).where(F.col("start") <= F.col("stop"))
    rows = rows.withColumn("_new", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int")).withColumn("_part", F.sum("_new").over(own))
    rows = rows.groupBy("product", "strand", "_part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    edges = rows.select(F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct((F.col("stop") + 1).alias("at"), F.lit(-1).alias("step")))).alias("_e"))
    edges = edges.groupBy(F.col("_e.at").alias("at")).agg(F.sum("_e.step").alias("step")).withColumn("_block", F.floor(F.col("at") / BLOCK))
    blocks = edges.groupBy("_block").agg(F.sum("step").alias("_sum"), F.min("at").alias("_least"))
    line = Window.orderBy("_block")  # one row for a block
    blocks = blocks.select("_block", F.coalesce(F.sum("_sum").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_least").over(line).alias("_next"))
    inside = Window.partitionBy("_block").orderBy("at")
    found = edges.join(blocks, "_block").select(F.col("at").alias("start"), (F.coalesce(F.lead("at").over(inside), "_next") - 1).alias("stop"), (F.col("_before") + F.sum("step").over(inside)).alias("products"))
    return found.where(F.col("products") > 0)


def interval_sites(intervals: DataFrame) -> DataFrame:
    """site, overlapping_ORFs of ``overlap_intervals``: products that cover a site, less one."""
    return intervals.select(F.explode(F.sequence("start", "stop")).alias("site"), (F.col("products") - 1).alias("overlapping_ORFs"))


def pool_sites(variants: DataFrame, cds: DataFrame, reference: DataFrame, every_cds: DataFrame | None = None) -> DataFrame:
    """A row for each polymorphic site and product (``noncoding`` where none covers it), with its classes.

    class compares the alleles of the sample with each other, class_vs_ref with the reference codon; both come
    from the site's own row, which has its codon and the reads of each base. ``every_cds``, in the
    same coordinates, names the products of both strands, which all count as overlapping.
    """
    counts = with_diversity(pool_counts(variants)).where("polymorphic")
    placed = counts.join(cds.select("site", "product", "codon_num", "position_in_codon", "codon_start_site"), "site", "left")
    placed = placed.join(reference_codons(cds, reference).select("product", "codon_num", "codon"), ["product", "codon_num"], "left")
    found = placed.join(overlaps(cds if every_cds is None else every_cds), "site", "left")
    at = F.col("position_in_codon")
    seen = F.filter(F.array(*[F.struct(F.lit(b).alias("nt"), F.col(b).alias("cnt")) for b in BASES]), lambda x: x["cnt"] > 0)
    made = lambda x: translated(F.concat(F.substring("codon", F.lit(1), at - 1), x["nt"], F.substring("codon", at + 1, F.lit(3))))
    own = translated(F.col("codon"))
    others = F.transform(F.filter(seen, lambda x: x["nt"] != F.col("ref_nt")), made)
    versus = F.when(F.forall(others, lambda a: a == own), "Synonymous").when(F.forall(others, lambda a: a != own), "Nonsynonymous").otherwise("Ambiguous")
    coding = F.col("codon").isNotNull()
    return found.select(
        "file", F.coalesce("product", F.lit("noncoding")).alias("product"), "site", "ref_nt", "maj_nt", "position_in_codon", F.coalesce("overlapping_ORFs", F.lit(0).cast("long")).alias("overlapping_ORFs"),
        "codon_start_site", "codon", "pi", "gdiv", F.when(coding, versus).alias("class_vs_ref"), F.when(coding, variant_type(F.transform(seen, made))).alias("class"), "coverage", *BASES,
    )


def variant_codons(counts: DataFrame, cds: DataFrame, codons: DataFrame) -> DataFrame:
    """file, product, codon_num, ref_codon and _at: for each of the three sites in order its bases with reads (nt, cnt), n (their sum), coverage and gdiv.

    A site without a variant has the reference's base alone. All that a codon's measures need is in its row.
    """
    reads = F.filter(F.array(*[F.struct(F.lit(b).alias("nt"), F.col(b).cast("double").alias("cnt")) for b in BASES]), lambda x: x["cnt"] > 0)
    coding = counts.join(cds.select("site", "product", "codon_num", "position_in_codon"), "site")
    one = lambda i: F.first(F.when(F.col("position_in_codon") == i, F.struct(reads.alias("reads"), F.col("coverage").cast("double").alias("coverage"), F.when(F.col("polymorphic"), F.col("gdiv")).alias("gdiv"))), ignorenulls=True)
    held = coding.groupBy("file", "product", "codon_num").agg(*[one(i).alias(f"_{i}") for i in (1, 2, 3)])
    held = held.join(codons.select("product", "codon_num", F.col("codon").alias("ref_codon")), ["product", "codon_num"])
    plain = lambda i: F.struct(F.array(F.struct(F.substring("ref_codon", i, 1).alias("nt"), F.lit(1.0).alias("cnt"))).alias("reads"), F.lit(1.0).alias("coverage"), F.lit(None).cast("double").alias("gdiv"))
    return held.select("file", "product", "codon_num", "ref_codon", F.array(*[F.coalesce(f"_{i}", plain(i)) for i in (1, 2, 3)]).alias("_at"))


def _made(i: int, nt: Column) -> Column:
    """The reference codon with another base at place ``i`` (from 0)."""
    return F.concat(F.substring("ref_codon", 1, i), nt, F.substring("ref_codon", i + 2, 3))


def haplotypes() -> Column:
    """Of a row of ``variant_codons``: the codons that its sites' bases make (b) with the products of their frequencies (w); with the reference codon as a."""
    at = [F.col("_at")[i]["reads"] for i in range(3)]
    total = [F.aggregate(x, F.lit(0.0), lambda n, y: n + y["cnt"]) for x in at]
    share = lambda i, x: x["cnt"] / total[i]
    made = lambda x: F.transform(at[1], lambda y: F.transform(at[2], lambda z: F.struct(F.lit("h").alias("kind"), F.col("ref_codon").alias("a"), F.concat(x["nt"], y["nt"], z["nt"]).alias("b"), (share(0, x) * share(1, y) * share(2, z)).alias("w"))))
    return F.flatten(F.transform(at[0], lambda x: F.flatten(made(x))))


def _site_pairs(i: int) -> Column:
    """Pairs of a site's bases, each in the reference codon, weighted by their share of the pairs of reads."""
    reads, n = F.col("_at")[i]["reads"], F.col("_at")[i]["coverage"]
    weight = lambda x, y: F.when(n > 1, x["cnt"] * y["cnt"] / (n * (n - 1) / 2)).otherwise(0.0)
    return F.flatten(F.transform(reads, lambda x, k: F.transform(F.slice(reads, k + 2, 4), lambda y: F.struct(F.lit("d").alias("kind"), _made(i, x["nt"]).alias("a"), _made(i, y["nt"]).alias("b"), weight(x, y).alias("w")))))


def pool_codons(variants: DataFrame, cds: DataFrame, reference: DataFrame, every_cds: DataFrame | None = None) -> DataFrame:
    """A row for each codon of each product: differences, sites and gene diversity; codons without variants have the reference's sites. ``every_cds`` as in ``pool_sites``.

    Reads are counted once. A codon's haplotypes, pairs and classes come from its own row of ``variant_codons``, so
    that nothing is shuffled again by codon.
    """
    counts = with_diversity(pool_counts(variants))
    codons = reference_codons(cds, reference)
    every = with_every_file(with_sites(codons).withColumnsRenamed({"n_sites": "N_sites_ref", "s_sites": "S_sites_ref"}).drop("aa"), variants)
    covered = cds.join(overlaps(cds if every_cds is None else every_cds), "site").groupBy("product", "codon_num").agg(F.sum((F.col("overlapping_ORFs") > 0).cast("long")).alias("num_overlap_ORF_nts"))
    place = ["file", "product", "codon_num"]
    acids = lambda i: F.transform(F.col("_at")[i]["reads"], lambda x: translated(_made(i, x["nt"])))
    kinds = F.filter(F.array(*[F.struct(F.col("_at")[i]["gdiv"].alias("gdiv"), variant_type(acids(i)).alias("class")) for i in range(3)]), lambda x: x["gdiv"].isNotNull())
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda n, y: n + y["gdiv"])
    mean = lambda kind: F.try_divide(total(F.filter("_kinds", lambda x: x["class"] == kind)), F.size(F.filter("_kinds", lambda x: x["class"] == kind)))
    rows = variant_codons(counts, cds, codons).withColumn("_kinds", kinds)
    own = {"gdiv": total(F.col("_kinds")) / 3, "N_gdiv": mean("Nonsynonymous"), "S_gdiv": mean("Synonymous"), "variable_sites": F.size("_kinds")}
    rows = rows.select(*place, *[c.alias(f"_{k}") for k, c in own.items()], F.explode(F.concat(haplotypes(), *[_site_pairs(i) for i in range(3)])).alias("_x"))
    rows = with_differences(with_sites(rows.select(*place, *[f"_{k}" for k in own], "_x.kind", "_x.a", "_x.b", "_x.w"), "b"), "a", "b")
    summed = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col("w") * F.coalesce(c, F.lit(0.0))).otherwise(0.0))
    measures = {"N_diffs": ("d", "n_diff"), "S_diffs": ("d", "s_diff"), "N_diffs_vs_ref": ("h", "n_diff"), "S_diffs_vs_ref": ("h", "s_diff"), "_n": ("h", "n_sites"), "_s": ("h", "s_sites")}
    found = rows.groupBy(*place).agg(*[F.first(f"_{k}").alias(k) for k in own], *[summed(*m).alias(k) for k, m in measures.items()])
    found = every.join(covered, ["product", "codon_num"], "left").join(found, place, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return found.select(
        "file", "product", "codon_num", F.col("codon_start_site").alias("site"), "codon", "num_overlap_ORF_nts", *[zero(c).alias(c) for c in ("N_diffs", "S_diffs")],
        F.coalesce("_n", zero("N_sites_ref")).alias("N_sites"), F.coalesce("_s", zero("S_sites_ref")).alias("S_sites"), zero("N_sites_ref").alias("N_sites_ref"), zero("S_sites_ref").alias("S_sites_ref"),
        *[zero(c).alias(c) for c in ("N_diffs_vs_ref", "S_diffs_vs_ref", "gdiv")], "N_gdiv", "S_gdiv", F.coalesce("variable_sites", F.lit(0)).alias("variable_sites"),
    )


SUMS = ("N_diffs", "S_diffs", "N_diffs_vs_ref", "S_diffs_vs_ref", "N_sites", "S_sites")


def _pool_rates(df: DataFrame) -> DataFrame:
    rate = {"piN": ("N_diffs", "N_sites"), "piS": ("S_diffs", "S_sites"), "mean_dN_vs_ref": ("N_diffs_vs_ref", "N_sites"), "mean_dS_vs_ref": ("S_diffs_vs_ref", "S_sites")}
    return df.withColumns({k: ratio(F.col(a), F.col(b)) for k, (a, b) in rate.items()})


def _mean_gdiv(kind: str | None = None) -> Column:
    return F.avg(F.col("gdiv") if kind is None else F.when(F.col("class") == kind, F.col("gdiv")))


def pool_products(codons: DataFrame, sites: DataFrame) -> DataFrame:
    """Sums, rates and gene diversity of each product, from ``pool_codons`` and ``pool_sites``."""
    sums = _pool_rates(codons.groupBy("file", "product").agg(*[F.sum(c).alias(c) for c in SUMS]))
    diversity = sites.groupBy("file", "product").agg(_mean_gdiv().alias("mean_gdiv_polymorphic"), _mean_gdiv("Nonsynonymous").alias("mean_N_gdiv"), _mean_gdiv("Synonymous").alias("mean_S_gdiv"))
    return sums.join(diversity, ["file", "product"], "left")


def pool_population(codons: DataFrame, sites: DataFrame, cds: DataFrame, reference: DataFrame) -> DataFrame:
    """One row for each file: the whole genome. Sites in several products count once, codon sums once for each product.

    ``reference`` is a table of sequences (seq) or of sites; only its size is asked.
    """
    size = F.sum(F.length("seq")) if "seq" in reference.columns else F.count("*")
    coding = cds.agg(F.count_distinct("site").alias("sites_coding"))
    genome = reference.agg(size.alias("sites")).crossJoin(coding).withColumn("sites_noncoding", F.col("sites") - F.col("sites_coding"))  # one row with one row
    once = sites.groupBy("file", "site").agg(F.max("pi").alias("pi"), F.max("gdiv").alias("gdiv"), F.min("class").alias("class"), F.max((F.col("product") != "noncoding").cast("int")).alias("_c"))
    c = F.col("_c") == 1
    poly = once.groupBy("file").agg(
        F.sum("pi").alias("_pi"), F.sum(F.when(c, F.col("pi")).otherwise(0.0)).alias("_pi_c"), F.sum("gdiv").alias("_gdiv"), F.avg("gdiv").alias("mean_gdiv_polymorphic"),
        _mean_gdiv("Nonsynonymous").alias("mean_N_gdiv"), _mean_gdiv("Synonymous").alias("mean_S_gdiv"), F.count("*").alias("sites_polymorphic"),
        F.avg(F.when(c, F.col("gdiv"))).alias("mean_gdiv_coding_poly"), F.count_if(c).alias("sites_coding_poly"), F.avg(F.when(~c, F.col("gdiv"))).alias("mean_gdiv_noncoding_poly"), F.count_if(~c).alias("sites_noncoding_poly"),
    )
    sums = _pool_rates(codons.groupBy("file").agg(*[F.sum(x).alias(x) for x in SUMS]))
    n, nc, nn = (F.col(f"_{k}") for k in ("sites", "sites_coding", "sites_noncoding"))
    found = sums.join(poly, "file", "left").join(F.broadcast(genome.select(*[F.col(c).alias(f"_{c}") for c in genome.columns])), F.lit(True))
    return found.select(
        "file", n.alias("sites"), nc.alias("sites_coding"), nn.alias("sites_noncoding"), F.try_divide(F.coalesce("_pi", F.lit(0.0)), n).alias("pi"), F.try_divide(F.coalesce("_pi_c", F.lit(0.0)), nc).alias("pi_coding"),
        F.try_divide(F.coalesce(F.col("_pi") - F.col("_pi_c"), F.lit(0.0)), nn).alias("pi_noncoding"), *SUMS, "piN", "piS", "mean_dN_vs_ref", "mean_dS_vs_ref",
        F.try_divide(F.coalesce("_gdiv", F.lit(0.0)), n).alias("mean_gdiv"), "mean_gdiv_polymorphic", "mean_N_gdiv", "mean_S_gdiv",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sites_polymorphic", "sites_coding_poly", "sites_noncoding_poly")], "mean_gdiv_coding_poly", "mean_gdiv_noncoding_poly",
    )


def warnings(variants: DataFrame, minfreq: float = 0.0) -> DataFrame:
    """file, site, message of what looks wrong in a whole report, and of the alleles that ``minfreq`` leaves out."""
    rules = F.array(
        F.when(F.coalesce(F.col("coverage"), F.lit(0.0)) <= 0, "coverage is 0"), F.when(F.col("count") > F.col("coverage"), "more variant reads than coverage"),
        F.when(F.length("ref") != F.length("alt"), "not a single-nucleotide variant"), F.when(F.col("freq") < minfreq, F.concat(F.lit("left out by its frequency: "), "alt")),
    )
    return variants.select("file", "site", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("message"))
