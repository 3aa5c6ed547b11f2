"""Relational operators: DataFrames in, lazily composed DataFrames out."""
