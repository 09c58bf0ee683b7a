"""Provenance analytics for recorded media on Spark DataFrames."""
