"""Sequence functions on string columns, all built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codonframe.genetics.code import CODE

CODON = "^[ACGT]{3}$"


def cleaned(seq: Column) -> Column:
    """Upper case, U as T, white space and carriage returns removed."""
    return F.replace(F.upper(F.regexp_replace(seq, r"\s+", "")), F.lit("U"), F.lit("T"))


def is_defined(codon: Column, strict_reference_missing: bool = False) -> Column:
    """Three of A, C, G, T; with ``strict_reference_missing`` anything without N and gap counts, ambiguity codes too."""
    found = (F.length(codon) == 3) & ~codon.rlike("[N-]") if strict_reference_missing else codon.rlike(CODON)
    return F.coalesce(found, F.lit(False))


def spliced(seq: Column, segments: Column) -> Column:
    """The coding sequence: 1-based inclusive segments (start, stop), in their order, one after another. Bytes are cut: a place in them is found at once."""
    raw = seq.cast("binary")
    return F.array_join(F.transform(segments, lambda s: F.substring(raw, s["start"], s["stop"] - s["start"] + 1).cast("string")), "")


def codons(cds: Column) -> Column:
    """Array of a coding sequence's codons; a rest of one or two letters is left out."""
    return F.regexp_extract_all(cds, F.lit("(?s)..."), F.lit(0))


def translated(codon: Column) -> Column:
    """Amino acid of a codon, DNA or RNA, any case; ``*`` for a stop, ``?`` for what is no codon."""
    table = F.create_map(*[F.lit(x) for pair in CODE.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.translate(F.upper(codon), "U", "T")), F.lit("?"))


def reverse_complement(seq: Column) -> Column:
    """Reversed, in upper case, with the bases complemented; other letters stay."""
    return F.translate(F.reverse(F.upper(seq)), "ACGT", "TGCA")


def reverse_complement_allele(allele: Column) -> Column:
    """Reversed and complemented with the case kept; U gives A."""
    return F.translate(F.reverse(allele), "acgtuACGTU", "tgcaaTGCAA")


def wrapped(seq: Column, width: int = 50) -> Column:
    """Broken into lines of ``width`` letters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
