"""Operators on DataFrames of the code graph."""
