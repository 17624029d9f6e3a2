"""embra: document, category and word embeddings on Spark DataFrames."""

__version__ = "0.1.0"
