"""Operators that also run on a streaming DataFrame."""
