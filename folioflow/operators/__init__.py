"""Operators over DataFrames: lookups, ranking, conditional formats, text, layout, state."""
