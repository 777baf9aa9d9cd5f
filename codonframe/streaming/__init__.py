"""Analyses of files that keep arriving."""
