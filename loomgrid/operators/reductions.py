"""Sums over index variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import VAL, Tensor


def reduce_modes(t: Tensor, over: Sequence[str]) -> Tensor:
    """Sums out the given variables."""
    left = tuple(m for m in t.modes if m not in over)
    shape = None if t.shape is None else tuple(t.dim(m) for m in left)
    if not left:
        return reduce_all(t)
    return Tensor(t.df.groupBy(*left).agg(F.sum(VAL).alias(VAL)), left, shape)


def reduce_all(t: Tensor) -> Tensor:
    """The sum of all entries: a tensor of order 0, one row (0 for no entries)."""
    total = F.sum(VAL)
    return Tensor(t.df.agg(F.coalesce(total, F.lit(0).cast(dict(t.df.dtypes)[VAL])).alias(VAL)), (), ())


def accumulate_vector(points: DataFrame, outer: str, inner: str) -> DataFrame:
    """Unordered inner coordinates, summed within their outer one."""
    return points.groupBy(outer, inner).agg(F.sum(VAL).alias(VAL))


def accumulate_matrix(points: DataFrame, modes: Sequence[str]) -> Tensor:
    """Unordered points, summed by coordinate."""
    return Tensor(points.groupBy(*modes).agg(F.sum(VAL).alias(VAL)), tuple(modes))


def col_sum(b: Tensor) -> Tensor:
    """x(j) = sum over i of B(i, j)."""
    return reduce_modes(b, b.modes[:1])


def slab_sum(b: Tensor) -> Tensor:
    """X(j, k) = sum over i of B(i, j, k)."""
    return reduce_modes(b, b.modes[:1])


def reduce_stats(t: Tensor, over: Sequence[str]) -> DataFrame:
    """Inputs, outputs, and outputs that are zero or not, of a reduction."""
    left = [m for m in t.modes if m not in over]
    out = t.df.groupBy(*left).agg(F.sum(VAL).alias("s"), F.count(F.lit(1)).alias("n"))
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("inputs"), F.count(F.lit(1)).alias("outputs"), F.count_if(F.col("s") == 0).alias("zero_outputs"), F.count_if(F.col("s") != 0).alias("nonzero_outputs"))


def accumulator_hits(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often an accumulator's keys are updated: most, keys hit more than once, keys, updates."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max("n").alias("max_hits"), F.count_if(F.col("n") > 1).alias("keys_hit_again"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("updates"))
