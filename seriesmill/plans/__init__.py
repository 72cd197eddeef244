"""Operators put together: data preparation and the analysis of a series."""
