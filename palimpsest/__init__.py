"""Palimpsest: memory analytics and corpus preparation on Spark DataFrames."""
