"""Semantic and relational analytics over DataFrames, and operators for training data."""
