"""Codon counts and within-group results over FASTA records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonframe.operators.codons import codon_columns, codon_counts
from codonframe.operators.within import product_results, within_codon
from codonframe.sources.fasta import EXTENSIONS, parse_fasta


def stream_fasta(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream of (group, seq_idx, header, seq) from FASTA files that appear in a folder."""
    raw = spark.readStream.format("text").option("lineSep", "\n>").option("pathGlobFilter", EXTENSIONS).option("maxFilesPerTrigger", max_files).load(folder)
    return parse_fasta(raw.select(F.col("_metadata.file_name").alias("group"), F.regexp_replace("value", "^>", "").alias("value")))


def stream_within(seqs: DataFrame, products: DataFrame, results: str, checkpoint: str):
    """Writes, after each batch, the results of the groups that were in it to ``results``/batch=<n>; returns the query.

    A file is a group and arrives whole, so its results are final after its
    batch; a batch that is run again replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        counts = codon_counts(codon_columns(batch, products))
        product_results(within_codon(counts)).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return seqs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
