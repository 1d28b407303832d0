"""Operators over job tables: DataFrames in, DataFrames out, nothing run eagerly."""
