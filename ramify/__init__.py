"""Skew-aware graph analytics on Spark DataFrames."""
