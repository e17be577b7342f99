"""Reusable physical patterns: long form, distributed ranks, ordered chunks, moments."""
