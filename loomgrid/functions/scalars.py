"""Casts of tensor values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_sparse(val: Column) -> Column:
    """A cast to long that keeps the sparsity pattern: [0, 1) is 1, (-1, 0) is -1, else half away from zero."""
    return F.when((val >= 0) & (val < 1), 1).when((val > -1) & (val < 0), -1).when(val > 0, F.floor(val + 0.5)).otherwise(F.ceil(val - 0.5)).cast("long")


def cast_trunc(val: Column, zero_to_one: bool = True) -> Column:
    """A truncating cast to long; what becomes 0 is 1, or stays 0."""
    cut = val.cast("long")
    return F.when(cut == 0, F.lit(1)).otherwise(cut).cast("long") if zero_to_one else cut
