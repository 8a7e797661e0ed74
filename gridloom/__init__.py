"""Gridded, trajectory and corpus data processing on Spark DataFrames."""
