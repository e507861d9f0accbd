"""Retrieval, usage analytics and incremental ingestion as Spark DataFrames."""
