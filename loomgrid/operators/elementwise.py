"""Projections, filters and coordinate arithmetic. All are narrow: no data is shuffled unless said."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import VAL, Tensor


def drop_zeros(t: Tensor) -> Tensor:
    """Without stored zeros; fibers that held nothing else are gone with them."""
    return t.keep(F.col(VAL) != 0)


def shift_last_mode(t: Tensor, value: int = 2, on_collision: str = "distinct") -> Tensor:
    """Last coordinate + 1, modulo its size; all values become ``value``.

    From order 3 on only even last coordinates move, so two entries can meet: one of them stays
    (``distinct``), or their values add up (``sum``); only then is there a shuffle.
    """
    last = t.modes[-1]
    moved = F.pmod(F.col(last) + 1, F.lit(t.dim(last)))
    to = moved if t.order <= 2 else F.when(F.col(last) % 2 == 0, moved).otherwise(F.col(last))
    df = t.df.select(*t.modes[:-1], to.alias(last), F.lit(value).cast(dict(t.df.dtypes)[VAL]).alias(VAL))
    if t.order > 2:
        if on_collision == "distinct":
            df = df.distinct()
        elif on_collision == "sum":
            df = df.groupBy(*t.modes).agg(F.sum(VAL).alias(VAL))
        else:
            raise ValueError("on_collision is distinct or sum")
    return replace(t, df=df)


def permute_modes(t: Tensor, order: Sequence[int]) -> Tensor:
    """Modes in another order; the entries stay."""
    modes = tuple(t.modes[k] for k in order)
    return Tensor(t.df.select(*modes, VAL), modes, None if t.shape is None else tuple(t.shape[k] for k in order))


def transpose(t: Tensor) -> Tensor:
    """The entries with coordinates swapped: the first mode's name now holds the last mode's coordinate."""
    back = permute_modes(t, range(t.order)[::-1])
    return back.rename(*t.modes)


def split(t: Tensor, mode: str, factor: int, original: bool = True, outer: str | None = None) -> Tensor:
    """A mode cut into strips: outer = crd div factor; the inner one is crd, or crd mod factor."""
    outer = outer or f"{mode}0"
    at = t.modes.index(mode)
    inner = F.col(mode) if original else F.pmod(mode, F.lit(factor))
    modes = (*t.modes[:at], outer, *t.modes[at:])
    columns = [F.floor(F.col(mode) / factor).cast("long").alias(outer) if m == outer else inner.alias(mode) if m == mode else F.col(m) for m in modes]
    shape = None if t.shape is None else (*t.shape[:at], -(-t.shape[at] // factor), t.shape[at] if original else factor, *t.shape[at + 1 :])
    return Tensor(t.df.select(*columns, VAL), modes, shape)


def flatten(t: Tensor, outer: str, inner: str, factor: int, into: str | None = None, dim: int | None = None) -> Tensor:
    """Two modes as one: outer * factor + inner."""
    into = into or inner
    modes = tuple(into if m == inner else m for m in t.modes if m != outer)
    columns = [(F.col(outer) * factor + F.col(inner)).alias(into) if m == into else F.col(m) for m in modes]
    shape = None if t.shape is None else tuple((dim or t.dim(outer) * factor) if m == into else t.dim(m) for m in modes)
    return Tensor(t.df.select(*columns, VAL), modes, shape)


def scalar_mul(b: float, c: Tensor) -> Tensor:
    return c.map(F.lit(b) * F.col(VAL))


def negate(t: Tensor) -> Tensor:
    return t.map(-F.col(VAL))


def add_columns(a: str, b: str, neg1: bool = False, neg2: bool = False) -> F.Column:
    """The sum of two aligned values, either of which may be negated."""
    x, y = F.col(a), F.col(b)
    return (-x if neg1 else x) + (-y if neg2 else y)


def mul_columns(a: str, b: str) -> F.Column:
    return F.col(a) * F.col(b)


def identity(t: Tensor) -> Tensor:
    return replace(t, df=t.rows)


def slice_box(t: Tensor, low: Sequence[int], high: Sequence[int]) -> Tensor:
    """The entries with low <= crd < high in every mode, counted from low."""
    inside = t
    for m, a, b in zip(t.modes, low, high, strict=True):
        inside = inside.keep((F.col(m) >= a) & (F.col(m) < b))
    columns = [(F.col(m) - a).alias(m) for m, a in zip(t.modes, low, strict=True)]
    return Tensor(inside.df.select(*columns, VAL), t.modes, tuple(b - a for a, b in zip(low, high, strict=True)))


def coords_to_points(fibers: DataFrame, outer: Sequence[str], fiber: str = "fiber", inner: str = "crd") -> DataFrame:
    """Every inner coordinate of nested fibers with its outer ones."""
    return fibers.select(*outer, F.explode(fiber).alias("_e")).select(*outer, F.col("_e.crd").alias(inner), F.col("_e.val").alias(VAL))
