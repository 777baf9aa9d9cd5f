"""Readers and writers: FASTA, GTF, variant reports, codon tables."""
