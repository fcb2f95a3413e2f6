"""lexforge: a document search, ranking and corpus preparation engine on Spark DataFrames."""

__version__ = "0.1.0"
