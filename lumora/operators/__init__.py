"""Operators over DataFrames: semantic, top-k and relational."""
