"""Aligned sequences from FASTA files, one group a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonframe.functions.sequence import cleaned, wrapped

EXTENSIONS = "*.{fa,fas,fasta}"


def read_fasta(spark: SparkSession, path: str | list[str], extensions: str = EXTENSIONS) -> DataFrame:
    """group (file name), seq_idx, header, seq; of files or of the FASTA files of a folder, which ``extensions`` tells by their names.

    A record runs from a ``>`` that begins a line to the next one; splitting
    there lets large files be read in parallel. Lines may end in a line feed, a
    carriage return or both; files with carriage returns alone are split in their rows.
    seq_idx is a hash of the record, the same on every read; no result depends on it.
    """
    reader = spark.read.option("lineSep", "\n>").option("pathGlobFilter", extensions)
    raw = reader.text(path).select(F.col("_metadata.file_name").alias("group"), F.col("value"))
    pieces = F.explode(F.split("value", r"\r+>")).alias("value")
    return parse_fasta(raw.select("group", pieces).select("group", F.regexp_replace("value", "^>", "").alias("value")))


def parse_fasta(records: DataFrame) -> DataFrame:
    """The same from (group, value), value being a record without its leading ``>``."""
    rows = records.where(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace("value", r"^[^\r\n]*", "")
    return rows.select("group", F.xxhash64("group", "value").alias("seq_idx"), F.trim(header).alias("header"), cleaned(body).alias("seq"))


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """chrom, seq of a file with exactly one sequence."""
    found = read_fasta(spark, path).select(F.col("header").alias("chrom"), "seq")
    if len(found.select("chrom").take(2)) != 1:
        raise ValueError(f"{path} must hold exactly one sequence")
    return found


def write_fasta(seqs: DataFrame, path: str, width: int = 50) -> None:
    """Text files of headers and sequences broken into lines."""
    text = F.concat(F.lit(">"), "header", F.lit("\n"), wrapped(F.col("seq"), width))
    seqs.select(text.alias("value")).write.mode("overwrite").text(path)
