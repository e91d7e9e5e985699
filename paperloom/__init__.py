"""paperloom: document analytics, retrieval and ingest on Spark DataFrames."""

__version__ = "0.1.0"
