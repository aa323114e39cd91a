"""Segment processing on Spark DataFrames."""
