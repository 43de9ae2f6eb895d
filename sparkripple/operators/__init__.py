"""Relational and graph operators; DataFrames in, DataFrames out."""
