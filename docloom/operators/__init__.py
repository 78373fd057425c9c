"""Operators: DataFrames of pages, mappings, records in, DataFrames out."""
