"""Bounded batches of a tensor's values."""
