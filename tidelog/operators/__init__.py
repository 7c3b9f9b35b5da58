"""Relational operators over the log model: DataFrames and explicit parameters in, DataFrames out."""
