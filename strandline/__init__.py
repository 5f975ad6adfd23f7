"""Sequence alignment and timeline analytics on Spark DataFrames."""
