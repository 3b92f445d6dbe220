"""Bulk evidence retrieval and table question answering on Spark DataFrames."""
