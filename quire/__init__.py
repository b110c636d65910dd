"""Quire: full-text indexing, retrieval and corpus analysis as Spark DataFrames."""
