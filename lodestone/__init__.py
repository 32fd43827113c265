"""Catalog-driven retrieval and triage over document and source-code corpora, on Spark DataFrames."""
