"""Tensor expressions as DataFrame plans."""
