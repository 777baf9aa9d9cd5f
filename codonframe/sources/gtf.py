"""Coding segments from GTF files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GENE = r'gene_id "(?:gene:)?([\w\s.\-:\']+)"'


def read_gtf(spark: SparkSession, path: str | list[str], strand: str | None = "+") -> DataFrame:
    """product, start, stop, strand of the CDS lines; of one strand, or of both where ``strand`` is null."""
    return parse_gtf(spark.read.text(path), strand)


def parse_gtf(lines: DataFrame, strand: str | None = "+") -> DataFrame:
    """The same from a ``value`` column of lines. CDS lines without a gene_id raise an error when they are read."""
    part = F.split("value", "\t")
    rows = lines.where(F.col("value").rlike(r"\tCDS\t\d+\t\d+\t[^\t]*\t[+-]"))
    gene = F.regexp_extract(F.col("value"), GENE, 1)
    named = F.when(gene != "", gene).otherwise(F.raise_error(F.concat(F.lit("CDS line without a gene_id: "), "value")).cast("string"))
    found = rows.select(named.alias("product"), part[3].cast("int").alias("start"), part[4].cast("int").alias("stop"), part[6].alias("strand"))
    return found if strand is None else found.where(F.col("strand") == strand)


def coding_products(segments: DataFrame) -> DataFrame:
    """product, strand and its segments in order of start; lengths that are no multiple of 3 raise an error when they are read."""
    found = segments.groupBy("product", "strand").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("segments"), F.sum(F.col("stop") - F.col("start") + 1).alias("_length")
    )
    checked = F.when(F.col("_length") % 3 == 0, F.col("segments")).otherwise(F.raise_error(F.concat(F.lit("coding length is no multiple of 3: "), "product")).cast("array<struct<start:int,stop:int>>"))
    return found.select("product", "strand", checked.alias("segments"))


def cds_sites(segments: DataFrame) -> DataFrame:
    """product, strand, site, codon_num, position_in_codon (1 to 3), codon_start_site of each coding base; one row for a base and product."""
    products = coding_products(segments)
    # Each codon is made with its place, so that a base carries nothing of the rest of its product.
    all_sites = F.flatten(F.transform("segments", lambda s: F.sequence(s["start"], s["stop"])))
    rows = products.select("product", "strand", all_sites.alias("_all"))
    numbers = F.sequence(F.lit(0), (F.size("_all") / 3).cast("int") - 1)
    each = F.transform(numbers, lambda i: F.struct((i + 1).alias("n"), F.array(*[F.get("_all", i * 3 + k) for k in range(3)]).alias("at")))
    found = rows.select("product", "strand", F.explode(each).alias("_c"))
    found = found.select("product", "strand", F.col("_c.n").alias("codon_num"), F.col("_c.at")[0].alias("codon_start_site"), F.posexplode("_c.at").alias("_at", "site"))
    return found.select("product", "strand", "site", "codon_num", (F.col("_at") + 1).cast("int").alias("position_in_codon"), "codon_start_site")


def both_strands(segments: DataFrame, length) -> DataFrame:
    """cds_sites of the products of both strands, in the coordinates of the + strand of a sequence of ``length``."""
    from codonframe.operators.revcom import revcom_segments

    other = cds_sites(revcom_segments(segments.where(F.col("strand") == "-"), length)).withColumn("strand", F.lit("-"))
    size = F.lit(length) if isinstance(length, int) else length
    turned = other.withColumns({"site": size - F.col("site") + 1, "codon_start_site": size - F.col("codon_start_site") + 1})
    return cds_sites(segments.where(F.col("strand") == "+")).unionByName(turned)


def write_gtf(segments: DataFrame, path: str, source: str = "codonframe") -> None:
    line = F.concat_ws("\t", F.lit("reference"), F.lit(source), F.lit("CDS"), F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", F.lit("0"), F.concat(F.lit('gene_id "'), "product", F.lit('";')))
    segments.select(line.alias("value")).write.mode("overwrite").text(path)
