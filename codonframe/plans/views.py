"""Genomics-shaped views of the test tables, by integer arithmetic alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonframe.sources.gtf import cds_sites, coding_products

#: Sites of the made-up reference, and its coding segments.
GENOME = 2000
SEGMENTS = [("P1", 100, 399), ("P2", 400, 699), ("P2", 900, 1199), ("P3", 1150, 1449)]
#: Of the other strand, in the coordinates of the first.
MINUS_SEGMENTS = [("M1", 301, 600), ("M2", 1201, 1350)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for queries that write files and read them: in the one that ``spark.checkpoint.dir`` names, on one machine a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="spark-files-")


def base(i: Column) -> Column:
    return F.substring(F.lit("ACGT"), (i + 1).cast("int"), F.lit(1))


def codon_of(i: Column) -> Column:
    return F.concat(base(F.floor(i / 16)), base(F.floor(i / 4) % 4), base(i % 4))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, product, codon_num, codon: five products of 60 codons, three groups, a third of the codons mutated, some undefined."""
    product, place = F.col("l_suppkey") % 5, F.col("l_partkey") % 60 + 1
    mutated = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 3 == 0, 1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 5).otherwise(0)
    codon = F.when(F.col("l_orderkey") % 17 == 0, "NNN").when(F.col("l_orderkey") % 19 == 0, "A-C").otherwise(codon_of((place * 7 + product * 11 + mutated) % 64))
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("group"), F.concat(F.lit("P"), product.cast("string")).alias("product"), place.cast("int").alias("codon_num"), codon.alias("codon"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("site"), base(F.col("l_suppkey") % 4).alias("nt"))


def ref_base(site: Column) -> Column:
    return base((site * site + F.floor(site / 7)) % 4)


def reference(spark: SparkSession) -> DataFrame:
    return spark.range(1, GENOME + 1).select(F.col("id").cast("int").alias("site"), ref_base(F.col("id")).alias("ref_nt"))


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, a, b, "+") for p, a, b in SEGMENTS], "product string, start int, stop int, strand string")


def both_segments(spark: SparkSession) -> DataFrame:
    return segments(spark).unionByName(spark.createDataFrame([(p, a, b, "-") for p, a, b in MINUS_SEGMENTS], "product string, start int, stop int, strand string"))


def coding(spark: SparkSession) -> DataFrame:
    return cds_sites(segments(spark))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, site, ref, alt, count, coverage, freq, products: two files, up to three alternatives at a site."""
    site = F.col("l_partkey") % GENOME + 1
    index = (site * site + F.floor(site / 7)) % 4
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("F"), (F.col("l_linenumber") % 2).cast("string")).alias("file"), site.cast("int").alias("site"), base(index).alias("ref"), base((index + 1 + F.col("l_suppkey") % 3) % 4).alias("alt"))
    counts = rows.groupBy("file", "site", "ref", "alt").agg(F.count("*").cast("double").alias("count"))
    counts = counts.withColumn("coverage", F.sum("count").over(Window.partitionBy("file", "site")) + 20 + F.col("site") % 13)
    return counts.select("file", "site", "ref", "alt", "count", "coverage", (F.col("count") / F.col("coverage")).alias("freq"), F.lit(None).cast("array<string>").alias("products"))


#: Products of the made-up sequences of 60 bases; the second is spliced, and named out of order.
FASTA_PRODUCTS = [("P1", 1, 30), ("P2", 31, 48), ("P2", 10, 21), ("P3", 40, 60)]


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group, value: a FASTA record for each customer, in three groups, broken into lines, partly in small letters and as RNA."""
    k, i = F.col("c_custkey"), F.col("_i")
    letter = F.when((k + i) % 41 == 0, "N").otherwise(base((k * (i + 3) + i * i + F.floor(k * k / 7) % (i + 2)) % 4))
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("_g"), F.posexplode(F.sequence(F.lit(1), F.lit(60))).alias("_at", "_i"))
    seqs = rows.groupBy("c_custkey", "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", letter.alias("nt")))), lambda x: x["nt"]), "").alias("seq"))
    cut = lambda a, n: F.substring("seq", a, n)
    body = F.concat(F.lit("\n"), cut(1, 25), F.lit("\r\n"), F.lower(cut(26, 20)), F.lit("\n\n"), F.translate(cut(46, 15), "T", "U"), F.lit("\n"))
    return seqs.select(F.concat(F.lit("g"), F.col("_g").cast("string")).alias("group"), F.concat(F.lit("s >"), F.col("c_custkey").cast("string"), body).alias("value"))


def fasta_products(spark: SparkSession) -> DataFrame:
    return coding_products(spark.createDataFrame([(p, a, b, "+") for p, a, b in FASTA_PRODUCTS], "product string, start int, stop int, strand string"))


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq: the letters A, C, G and T of each document's text, large or small. Others go first, in runs: in capitals some of them are several letters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^ACGTacgt]+", "")).alias("seq"))
