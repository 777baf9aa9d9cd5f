"""From sequences to codon counts, the table all alignment analyses start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonframe.functions.sequence import is_defined
from codonframe.genetics.code import with_sites

from . import pieces

KEY = ("group", "product", "codon_num")
#: Codons cut by a splice that are taken out of a sequence together.
BUCKET_ROWS = 1_000


def validated(seqs: DataFrame) -> DataFrame:
    """``seqs``; a ValueError if the sequences of a group differ in length.

    The lengths are looked at once, ahead of the analysis, so that no sequence has to be shuffled to its group's lengths.
    """
    sizes = seqs.groupBy("group").agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"))
    wrong = sizes.where("lo <> hi").first()
    if wrong is not None:
        raise ValueError(f"sequences of different lengths in {wrong['group']}: {wrong['lo']} to {wrong['hi']} bases")
    return seqs


def codon_columns(seqs: DataFrame, products: DataFrame) -> DataFrame:
    """group, product, codon_num, codon: a row for each codon of each sequence and product.

    ``products`` holds product and segments. Sequences are cut into pieces, which meet the coding
    segments that begin codons in them, so that time is linear in their length.
    The few codons that a splice cuts are taken from the sequence itself: they are dealt into buckets of some
    ``BUCKET_ROWS``, and each sequence meets each bucket. Annotations are broadcast up to
    a size by their own measure, and joined beyond. A product that reaches beyond its sequence is an error when the codons are read.
    """
    whole = pieces.unbroken_codons(pieces.cut(seqs, "group"), products, ("group",))
    split = pieces.spliced_codons(products)
    n = split.count()
    if not n:
        return whole
    buckets = -(-n // BUCKET_ROWS)
    known = split.groupBy(F.pmod(F.xxhash64("product", "codon_num"), F.lit(buckets)).cast("int").alias("_bucket")).agg(F.collect_list(F.struct("product", "codon_num", "sites")).alias("_split"))
    known = pieces.sent(known, F.aggregate("_split", F.lit(0), lambda a, x: a + F.length(x["product"]) + 64))
    met = seqs.select("group", F.col("seq").cast("binary").alias("_raw"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket")).join(known, "_bucket")
    letter = lambda site: F.substring(F.col("_raw"), site.cast("int"), F.lit(1)).cast("string")
    found = F.transform("_split", lambda x: F.struct(x["product"].alias("product"), x["codon_num"].alias("codon_num"), F.concat(*[letter(x["sites"][i]) for i in range(3)]).alias("codon")))
    return whole.unionByName(met.select("group", F.explode(found).alias("_c")).select("group", "_c.product", "_c.codon_num", "_c.codon"))


def codon_counts(columns: DataFrame, strict_reference_missing: bool = False) -> DataFrame:
    """group, product, codon_num, codon, cnt; undefined codons of a place share a row with a null codon.

    At most 64 defined codons, and few others, remain of any number of
    sequences, so everything that compares sequences afterwards works on these rows.
    """
    defined = is_defined(F.col("codon"), strict_reference_missing)
    return columns.withColumn("codon", F.when(defined, F.col("codon"))).groupBy(*KEY, "codon").agg(F.count("*").alias("cnt"))


def places(counts: DataFrame) -> DataFrame:
    """A row for each codon place: num_defined, mean N_sites and S_sites, and alleles, its defined codons with cnt in the order of the alphabet.

    Everything that compares codons works on these rows: an array of at most 64,
    or of the few ambiguity codes more that ``strict_reference_missing`` lets in.
    The mean sites over all pairs of sequences are the mean over sequences, as each is in equally many pairs.
    """
    here = F.col("codon").isNotNull()
    n = F.sum(F.when(here, F.col("cnt")).otherwise(0))
    mean = lambda c: F.coalesce(F.try_divide(F.sum(F.when(here, F.col("cnt") * F.coalesce(c, F.lit(0.0)))), n), F.lit(0.0))
    alleles = F.array_sort(F.collect_list(F.when(here, F.struct("codon", "cnt"))))
    return with_sites(counts).groupBy(*KEY).agg(n.alias("num_defined"), mean("n_sites").alias("N_sites"), mean("s_sites").alias("S_sites"), alleles.alias("alleles"))


def defined_counts(counts: DataFrame) -> DataFrame:
    """group, product, codon_num, num_defined, num_alleles."""
    here = F.col("codon").isNotNull()
    return counts.groupBy(*KEY).agg(F.sum(F.when(here, F.col("cnt")).otherwise(0)).alias("num_defined"), F.count("codon").alias("num_alleles"))
