"""Codon tables of earlier runs, and result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = ("N_sites", "S_sites", "N_diffs", "S_diffs")


def read_codon_results(spark: SparkSession, path: str) -> DataFrame:
    """A tab- or comma-separated codon table with its columns by name; measures as doubles, ``codon_num`` from ``codon`` where that holds numbers."""
    raw = spark.read.option("sep", detect_delimiter(spark, path)).option("header", True).csv(path)
    typed = raw.withColumns({c: F.col(c).try_cast("double") for c in raw.columns if c in MEASURES or c.endswith("_diffs_vs_ref") or c.startswith("num_defined")})
    return with_codon_numbers(typed)


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """Tab or comma, by the header: the first line that is no ``##`` comment."""
    lines = [r[0] for r in spark.read.text(path).where(~F.col("value").startswith("##") & (F.trim("value") != "")).limit(1).collect()]
    if not lines:
        raise ValueError(f"{path} has no header")
    found = "\t" if "\t" in lines[0] else "," if "," in lines[0] else None
    if found is None:
        raise ValueError(f"the header of {path} has neither tabs nor commas")
    return found


def codon_schema(df: DataFrame) -> str:
    """``pool``, ``between`` or ``within``, by the columns that are there."""
    if "N_diffs_vs_ref" in df.columns:
        return "pool"
    return "between" if "num_defined_codons_g1" in df.columns else "within"


def with_codon_numbers(df: DataFrame) -> DataFrame:
    """codon_num and num_defined_seqs for each kind of codon table.

    Between groups the smaller group counts. Pool tables name a codon's first
    site: numbers follow from the sites where all of a product of a file are in one frame, else from their order.
    """
    kind = codon_schema(df)
    if kind == "pool":
        from pyspark.sql import Window

        product = Window.partitionBy(*[c for c in ("file", "product", "strand") if c in df.columns])
        frame = (F.col("site").cast("int") - F.min(F.col("site").cast("int")).over(product)) / 3 + 1
        df = df.withColumn("_frame", frame).withColumn("_bad", F.max((F.col("_frame") != F.floor("_frame")).cast("int")).over(product))
        order = F.row_number().over(product.orderBy(F.col("site").cast("int")))
        return df.withColumn("codon_num", F.when(F.col("_bad") == 1, order).otherwise(F.col("_frame").cast("int"))).withColumn("num_defined_seqs", F.lit(100.0)).drop("_frame", "_bad")
    if "codon_num" not in df.columns and "codon" in df.columns:
        df = df.withColumn("codon_num", F.regexp_replace("codon", r"codon_|\s", "").try_cast("int"))
    if kind == "between" and "num_defined_seqs" not in df.columns:
        df = df.withColumn("num_defined_seqs", F.least("num_defined_codons_g1", "num_defined_codons_g2"))
    return df.withColumn("codon_num", F.col("codon_num").try_cast("int")) if "codon_num" in df.columns else df


def write_tsv(df: DataFrame, path: str, missing: str = "NA") -> None:
    """Tab-separated files with a header; arrays are joined by commas, nulls written as ``missing``. Existing files are replaced."""
    flat = df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", missing).option("emptyValue", "").csv(path)
