"""Paired-event analytics on Spark DataFrames."""
