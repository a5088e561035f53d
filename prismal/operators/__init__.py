"""Operators: DataFrame in, DataFrame out, columns by name."""
