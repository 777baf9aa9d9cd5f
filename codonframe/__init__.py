"""Codon-aware population genetics on Spark DataFrames."""
