"""Operators of a training-data pipeline: language, duplicates, leaks, packing, safety."""
