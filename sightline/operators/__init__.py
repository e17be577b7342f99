"""Operators: each takes a DataFrame and returns a DataFrame with a fixed schema."""
