"""Relational operators of the risk engine: lazy functions from DataFrames to DataFrames."""
