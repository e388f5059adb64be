"""Operators: each takes DataFrames (and small parameters) and returns a DataFrame."""
