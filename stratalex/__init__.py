"""Spark-first retrieval analytics: corpus cleaning, indexing, ranking, citation checks and evaluation as DataFrames."""
