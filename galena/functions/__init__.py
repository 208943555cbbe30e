"""Protected scalar operators, as Spark columns and as numpy functions with the same values."""
