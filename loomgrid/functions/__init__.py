"""Scalar functions on values."""
