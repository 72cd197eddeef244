"""Operators on series: every function takes and returns DataFrames."""
