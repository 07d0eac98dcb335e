"""Co-iteration of tensors as joins on shared index variables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import VAL, Tensor


#: Pairs of rows without a common variable that are made without being asked twice.
PAIRS = 50_000_000


def guard_pairs(a: DataFrame, b: DataFrame, most: int | None = None) -> None:
    """Refuses to pair all rows of both where that makes more than ``most`` rows (PAIRS, unless given)."""
    n, m = a.count(), b.count()
    if n * m > (PAIRS if most is None else most):
        raise ValueError(f"{n} x {m} pairs; raise the limit to make them")


def _as(t: Tensor, val: str) -> DataFrame:
    return t.df.select(*t.modes, F.col(VAL).alias(val))


def intersect(a: Tensor, b: Tensor, on: Sequence[str] | None = None) -> DataFrame:
    """Entries of both tensors that agree in the shared variables, with both values (val_a, val_b)."""
    on = list(on or [m for m in a.modes if m in b.modes])
    return _as(a, "val_a").join(_as(b, "val_b"), on)


def union(a: Tensor, b: Tensor, fill: float = 0) -> DataFrame:
    """All coordinates of either, with both values; a missing side has the fill value."""
    both = _as(a, "val_a").join(_as(b, "val_b"), list(a.modes), "full_outer")
    return both.select(*a.modes, *[F.coalesce(v, F.lit(fill).cast(dict(both.dtypes)[v])).alias(v) for v in ("val_a", "val_b")])


def union_all_n(tensors: Sequence[Tensor]) -> Tensor:
    """The sum of tensors of the same modes: one union and one aggregation, which combines before it shuffles."""
    first = tensors[0]
    rows = reduce(DataFrame.unionByName, [t.rows for t in tensors])
    return Tensor(rows.groupBy(*first.modes).agg(F.sum(VAL).alias(VAL)), first.modes, first.shape)


def locate(a: Tensor, dense: Tensor, on: Sequence[str] | None = None, keep_missing: bool = False) -> DataFrame:
    """Every entry of ``a`` with the value looked up in the other; no co-iteration of the latter's own entries."""
    on = list(on or [m for m in a.modes if m in dense.modes])
    return _as(a, "val_a").join(_as(dense, "val_b"), on, "left" if keep_missing else "inner")


def repeat(a: Tensor, over: DataFrame, most: int | None = None) -> Tensor:
    """Every entry for each coordinate of other index variables (``over``: distinct coordinates, shared ones join; without one, up to ``most`` rows are made)."""
    shared = [m for m in a.modes if m in over.columns]
    if not shared:
        guard_pairs(a.df, over, most)
    new = tuple(c for c in over.columns if c not in a.modes)
    df = a.rows.join(over, shared) if shared else a.rows.join(over, F.lit(True))
    return Tensor(df.select(*a.modes, *new, VAL), (*a.modes, *new))


def drop_empty_outer(outer: DataFrame, inner: DataFrame, on: Sequence[str]) -> DataFrame:
    """Outer coordinates with at least one inner one."""
    return outer.join(inner, list(on), "left_semi")


def anti_coords(a: Tensor, b: Tensor) -> DataFrame:
    """Coordinates of ``a`` that ``b`` lacks."""
    return a.df.select(*a.modes).join(b.df.select(*b.modes), list(a.modes), "left_anti")
