"""Hybrid code and document search on Spark DataFrames."""
