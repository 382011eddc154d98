"""Operators on tensors, as DataFrame plans."""
