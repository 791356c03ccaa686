"""Variant analytics on Spark DataFrames."""
