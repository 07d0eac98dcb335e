"""Readers and writers of tensor files."""
