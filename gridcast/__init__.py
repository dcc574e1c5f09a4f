"""Gridded-forecast analytics on Spark DataFrames."""
