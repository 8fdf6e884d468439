"""Operators on tree samples and clade tables: each takes and returns DataFrames."""
