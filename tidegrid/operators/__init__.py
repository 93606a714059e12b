"""Operators over DataFrames: views, diffs, merges, ranks."""
