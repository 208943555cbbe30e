"""Symbolic formula discovery on Spark DataFrames."""
