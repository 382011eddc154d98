"""Column expressions: dtypes, casts and scalar functions."""
