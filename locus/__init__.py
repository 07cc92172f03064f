"""Regulatory-sequence analytics on Spark DataFrames."""
