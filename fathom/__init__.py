"""fathom: retrieval, ranking and learning-to-rank on Spark DataFrames."""

__version__ = "0.1.0"
