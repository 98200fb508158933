"""Column functions: texts, vectors, metrics."""
