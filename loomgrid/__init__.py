"""Sparse-tensor and corpus jobs as plain Spark DataFrame work."""
