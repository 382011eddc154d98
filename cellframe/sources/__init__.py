"""Tensors from and to DataFrames and files."""
