"""Slatework: hybrid retrieval, code analytics and corpus tooling on Spark DataFrames."""

__version__ = "0.1.0"
