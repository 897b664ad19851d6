"""Tessera: evidence-based catalog curation on Spark DataFrames."""
