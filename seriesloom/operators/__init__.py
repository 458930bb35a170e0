"""Operators: each maps DataFrames to DataFrames."""
