"""Operators: each takes and returns DataFrames and builds lazily."""
