"""The other strand: sequences, coordinates and variants seen from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codonframe.functions.sequence import reverse_complement, reverse_complement_allele


def revcom_sequences(seqs: DataFrame) -> DataFrame:
    """Sequences reversed and complemented, their headers marked."""
    return seqs.withColumns({"seq": reverse_complement(F.col("seq")), "header": F.concat("header", F.lit("_revcom"))})


def revcom_segments(segments: DataFrame, length: Column | int) -> DataFrame:
    """Segments in the coordinates of the other strand of a sequence of ``length``; a segment that mirrors itself is turned once, too."""
    size = F.lit(length) if isinstance(length, int) else length
    turned = F.when(F.col("strand") == "+", "-").when(F.col("strand") == "-", "+").otherwise(F.col("strand"))
    return segments.withColumns({"start": size - F.col("stop") + 1, "stop": size - F.col("start") + 1, "strand": turned})


def revcom_vcf(rows: DataFrame, length: Column | int, legacy_alt_order: bool = False) -> DataFrame:
    """VCF rows (POS, REF, ALT, INFO) on the other strand. Ancestral alleles in INFO follow.

    Alternatives keep their order, which their frequencies share; ``legacy_alt_order`` reverses it.
    """
    size = F.lit(length) if isinstance(length, int) else length
    each = F.transform(F.split("ALT", ","), reverse_complement_allele)
    ancestral = F.regexp_extract("INFO", r"(?:^|;)AA=([^;]*)", 1)
    info = F.when(ancestral != "", F.regexp_replace(F.col("INFO"), F.lit(r"(^|;)AA=[^;]*"), F.concat(F.lit("$1AA="), reverse_complement_allele(ancestral)))).otherwise(F.col("INFO"))
    return rows.withColumns({
        "POS": size - F.col("POS") + 1 - (F.length("REF") - 1), "REF": reverse_complement_allele(F.col("REF")),
        "ALT": F.array_join(F.reverse(each) if legacy_alt_order else each, ","), "INFO": info,
    })
