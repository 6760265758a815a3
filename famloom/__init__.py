"""Clustering of pairwise interval alignments into families, on Spark DataFrames."""

__version__ = "0.1.0"
