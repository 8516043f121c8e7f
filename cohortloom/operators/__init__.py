"""Operators on panels: DataFrames in, DataFrames out."""
