"""Variant reports of pooled samples in one shape.

Every reader returns file, site, ref, alt, count, coverage, freq (a fraction) and
products (array of the annotations the report names; null where it names none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codonframe.functions.sequence import reverse_complement_allele

#: Bytes of header lines up to which they are sent to all tasks.
HEADER_BYTES = 64 << 20
COLUMNS = ("file", "site", "ref", "alt", "count", "coverage", "freq", "products")
CLC = {"site": "Reference Position", "type": "Type", "ref": "Reference", "alt": "Allele", "count": "Count", "coverage": "Coverage", "freq": "Frequency", "products": "Overlapping annotations"}
#: Columns of a VCF line that are read by name.
_READ = ("POS", "REF", "ALT", "INFO", "FORMAT")
GENEIOUS = {"site": "Minimum", "last": "Maximum", "type": "Polymorphism Type", "product": "product", "change": "Change", "coverage": "Coverage", "freq": "Variant Frequency"}


def _cast(column: Column) -> Column:
    return F.regexp_replace(column, "[,%\\s]", "").try_cast("double")


def _report(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("sep", sep).option("header", True).option("quote", '"').csv(path).withColumn("file", F.col("_metadata.file_name"))


def parse_clc(report: DataFrame) -> DataFrame:
    """From the columns of a CLC report; only single-nucleotide variants. Frequencies are percentages."""
    at = {k: F.col(f"`{v}`") for k, v in CLC.items()}
    rows = report.where(at["type"] == "SNV")
    products = F.regexp_extract_all(at["products"], F.lit("CDS: ([^,]+)"), F.lit(1))
    return rows.select("file", at["site"].try_cast("int").alias("site"), at["ref"].alias("ref"), at["alt"].alias("alt"), _cast(at["count"]).alias("count"), _cast(at["coverage"]).alias("coverage"), (_cast(at["freq"]) / 100).alias("freq"), products.alias("products"))


def read_clc(spark: SparkSession, path: str) -> DataFrame:
    return parse_clc(_report(spark, path, "\t"))


def parse_geneious(report: DataFrame) -> DataFrame:
    """From the columns of a Geneious report, which has a row for each product; a variant's rows become one. Counts are frequency times coverage."""
    at = {k: F.col(f"`{v}`") for k, v in GENEIOUS.items()}
    rows = report.where(at["type"].startswith("SNP") & (at["site"] == at["last"]))
    change = F.split(at["change"], " -> ")
    rows = rows.select("file", at["site"].try_cast("int").alias("site"), change[0].alias("ref"), change[1].alias("alt"), _cast(at["coverage"]).alias("coverage"), (_cast(at["freq"]) / 100).alias("freq"), at["product"].alias("_product"))
    found = rows.groupBy("file", "site", "ref", "alt").agg(F.max("coverage").alias("coverage"), F.max("freq").alias("freq"), F.array_sort(F.collect_set(F.when(F.col("_product") != "", F.col("_product")))).alias("products"))
    return found.withColumn("count", F.col("freq") * F.col("coverage")).select(*COLUMNS)


def read_geneious(spark: SparkSession, path: str) -> DataFrame:
    return parse_geneious(_report(spark, path, ","))


def _info(key: str) -> Column:
    found = F.regexp_extract("INFO", rf"(?:^|;){key}=([^;]*)", 1)
    return F.when(found != "", found)


def _numbers(text: Column) -> Column:
    return F.split(text, ",").try_cast("array<double>")


def _place_of_ad() -> Column:
    """The place of AD among a line's FORMAT, 0 where it has none."""
    keys = F.split("FORMAT", ":")
    twice = F.raise_error(F.concat_ws("", F.lit("AD is twice in the FORMAT of a line of "), "file")).cast("int")
    return F.when(F.size(F.array_remove(keys, "AD")) < F.size(keys) - 1, twice).otherwise(F.array_position(keys, "AD").cast("int"))


def _reads_of_samples(lines: DataFrame) -> DataFrame:
    """The rows of format 4: file, site, ref, _alts, _place (of AD) and _each (sample and value) of each line.

    What belongs to a line is made before its samples are rows, and what belongs to a
    sample before its alternatives are. Arrays are taken apart by outer explosion, as an
    inner one makes each array once more to ask for its size; what has no element has no
    share and goes with those. DP either equals the sum of AD or gives way to it.
    """
    each = lines.select("file", "site", "ref", "_alts", "_place", F.explode_outer("_each").alias("_s"))
    ad = _numbers(F.when(F.col("_place") > 0, F.split_part("_s.value", F.lit(":"), F.col("_place"))))
    each = each.select(F.concat_ws(":", "file", "_s.sample").alias("file"), "site", "ref", "_alts", ad.alias("_ad"))
    summed = F.aggregate("_ad", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    each = each.withColumn("coverage", summed).select("file", "site", "ref", "_ad", "coverage", F.posexplode_outer("_alts").alias("_i", "alt"))
    reads, some = F.get("_ad", F.col("_i") + 1), F.col("coverage") > 0
    # An alternative beyond the end of AD is unknown; one whose sample has no reads has none.
    freq = F.when(F.size("_ad") > F.col("_i") + 1, F.when(some, reads / F.col("coverage")).otherwise(0.0))
    out = each.select("file", "site", "ref", "alt", F.when(some, reads).otherwise(0.0).alias("count"), "coverage", freq.alias("freq"), F.lit(None).cast("array<string>").alias("products"))
    return out.where(F.col("freq").isNotNull()).select(*COLUMNS)


def parse_vcf(rows: DataFrame, vcf_format: int, samples: list[str] | None = None) -> DataFrame:
    """From the columns of a VCF (file, POS, REF, ALT, INFO and, for format 4, FORMAT and ``samples``, or an array ``_samples`` of sample and value).

    1: AN (or NS) and AF. 2: DP and AF. 3: DP4, the other reads dealt evenly to
    several alternatives. 4: AD and DP of each sample; where DP is not the sum of
    AD, the sum counts. In format 4 the file is joined with the sample's name.
    """
    alts = F.split("ALT", ",")
    base = ["file", F.col("POS").cast("int").alias("site"), F.col("REF").alias("ref"), alts.alias("_alts")]
    if vcf_format in (1, 2):
        total = F.coalesce(_info("AN"), _info("NS")) if vcf_format == 1 else _info("DP")
        found = rows.select(*base, total.try_cast("double").alias("coverage"), _numbers(_info("AF")).alias("_freqs"))
    elif vcf_format == 3:
        depth = _numbers(_info("DP4"))
        found = rows.select(*base, depth.alias("_d")).withColumn("coverage", F.col("_d")[0] + F.col("_d")[1] + F.col("_d")[2] + F.col("_d")[3])
        share = F.when(F.col("coverage") > 0, (F.col("_d")[2] + F.col("_d")[3]) / F.size("_alts") / F.col("coverage")).otherwise(0.0)
        found = found.withColumn("_freqs", F.transform("_alts", lambda _: share)).drop("_d")
    elif vcf_format == 4:
        if not samples and "_samples" not in rows.columns:
            raise ValueError("format 4 needs the names of the sample columns")
        each = F.col("_samples") if not samples else F.array(*[F.struct(F.lit(s).alias("sample"), F.col(f"`{s}`").alias("value")) for s in samples])
        return _reads_of_samples(rows.select(*base, _place_of_ad().alias("_place"), each.alias("_each")))
    else:
        raise ValueError(f"no VCF format {vcf_format}")
    each = found.select("file", "site", "ref", "coverage", F.explode(F.arrays_zip(F.col("_alts").alias("alt"), F.col("_freqs").alias("freq"))).alias("_x"))
    out = each.select("file", "site", "ref", F.col("_x.alt").alias("alt"), (F.col("_x.freq") * F.col("coverage")).alias("count"), "coverage", F.col("_x.freq").alias("freq"), F.lit(None).cast("array<string>").alias("products"))
    return out.where(F.col("freq").isNotNull()).select(*COLUMNS)


def parse_vcf_lines(lines: DataFrame, vcf_format: int) -> DataFrame:
    """From (file, value): the lines of any number of VCF files, each with its own ``#CHROM`` line.

    Columns and samples are those that a line's own file names, so files may differ in their
    samples and in the order of their columns. The header lines, one for each file, are
    sent to all tasks up to ``HEADER_BYTES`` by their own measure, and joined by file
    beyond. A file that has variants and no header is an error when they are read,
    and so is one with two different headers. Files without variants have no rows.
    """
    found = lines.where(F.col("value").startswith("#CHROM")).groupBy("file").agg(F.min("value").alias("_least"), F.max("value").alias("_most"))
    two = F.raise_error(F.concat(F.lit("two different #CHROM lines in "), "file")).cast("string")
    names = F.split(F.regexp_replace(F.when(F.col("_least") == F.col("_most"), F.col("_least")).otherwise(two), "^#", ""), "\t")
    # Places are found once a file, not once a line.
    headers = found.select("file", names.alias("_names")).select("file", *[F.array_position("_names", n).cast("int").alias(f"_at_{n}") for n in _READ], F.slice("_names", 10, F.size("_names")).alias("_who"))
    if (found.agg(F.sum(F.length("_least") + F.length("file"))).first()[0] or 0) <= HEADER_BYTES:
        headers = F.broadcast(headers)
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("file", F.split("value", "\t").alias("_part"))
    none = lambda kind: F.raise_error(F.concat_ws("", F.lit("no #CHROM line in "), "file")).cast(kind)
    body = body.join(headers, "file", "left").withColumn("_who", F.coalesce("_who", none("array<string>")))
    at = lambda name: F.get("_part", F.coalesce(f"_at_{name}", none("int")) - 1).alias(name)
    pair = F.arrays_zip(F.col("_who").alias("sample"), F.slice("_part", 10, F.size("_who")).alias("value"))
    return parse_vcf(body.select("file", *[at(n) for n in _READ], pair.alias("_samples")), vcf_format)


def read_vcf(spark: SparkSession, path: str | list[str], vcf_format: int) -> DataFrame:
    """One of the four supported layouts, of a file, of several or of a folder; each file's own header line names its columns and samples."""
    return parse_vcf_lines(spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value"), vcf_format)


def read_vcf_lines(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """Rows of one VCF file with their columns as text and ``_line``, an order of the file; its ``##`` lines and its column names."""
    lines = spark.read.text(path, wholetext=False).select("value", F.monotonically_increasing_id().alias("_line"))
    head = [r["value"] for r in lines.where(F.col("value").startswith("#")).orderBy("_line").collect()]  # a header, not the variants
    names = next((h.lstrip("#").split("\t") for h in head if h.startswith("#CHROM")), None)
    if names is None:
        raise ValueError(f"{path} has no #CHROM line")
    part = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("_line", *[F.get(part, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows.withColumn("POS", F.col("POS").cast("int")), [h for h in head if h.startswith("##")], names


def write_vcf(rows: DataFrame, path: str, head: list[str], names: list[str]) -> None:
    """Text files in the order of POS, each with the whole header, so that each is a VCF of its own."""
    text = F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit(".")) for n in names])
    top = "\n".join([*head, "#" + "\t".join(names)])
    # The low 33 bits of the id number a task's rows, which are a file's.
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    body = rows.repartitionByRange("POS").sortWithinPartitions("POS")
    body.select(F.when(first, F.concat(F.lit(f"{top}\n"), text)).otherwise(text).alias("value")).write.mode("overwrite").text(path)


def revcom_variants(variants: DataFrame, length: Column | int) -> DataFrame:
    """Variants of one base as the other strand of a sequence of ``length`` has them."""
    size = F.lit(length) if isinstance(length, int) else length
    return variants.withColumns({"site": (size - F.col("site") + 1).cast("int"), "ref": reverse_complement_allele(F.col("ref")), "alt": reverse_complement_allele(F.col("alt"))})


def merged(variants: DataFrame) -> DataFrame:
    """One row for a file, site and alternative: counts of repeated rows are summed."""
    key = ["file", "site", "ref", "alt"]
    return variants.groupBy(*key).agg(F.sum("count").alias("count"), F.max("coverage").alias("coverage"), F.first("products").alias("products")).withColumn("freq", F.when(F.col("coverage") > 0, F.col("count") / F.col("coverage")).otherwise(0.0)).select(*COLUMNS)


def minimum_frequency(variants: DataFrame, minfreq: float) -> DataFrame:
    """Alleles with a frequency of at least ``minfreq`` (a fraction)."""
    return variants.where(F.col("freq") >= minfreq)
