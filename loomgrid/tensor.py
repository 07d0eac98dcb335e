"""A sparse tensor: one row per stored entry, a long column per index variable, and ``val``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VAL = "val"


@dataclass(frozen=True)
class Tensor:
    """``df`` with the columns ``modes`` and ``val``; ``shape`` (a size per mode) is carried, never guessed.

    Coordinates count from 0; what isn't stored is 0. A result is canonical once its stored zeros
    are dropped.
    """

    df: DataFrame
    modes: tuple[str, ...]
    shape: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if missing := {*self.modes, VAL} - {*self.df.columns}:
            raise ValueError(f"no column {sorted(missing)}")
        if len({*self.modes}) != len(self.modes):
            raise ValueError("modes repeat")
        if self.shape is not None and len(self.shape) != len(self.modes):
            raise ValueError("the shape has another order than the tensor")

    @property
    def order(self) -> int:
        return len(self.modes)

    @property
    def rows(self) -> DataFrame:
        """The coordinates and values alone."""
        return self.df.select(*self.modes, VAL)

    def dim(self, mode: str) -> int:
        if self.shape is None:
            raise ValueError("the tensor has no shape")
        return self.shape[self.modes.index(mode)]

    def rename(self, *modes: str) -> Tensor:
        """The same entries under other index variables; no data moves."""
        if len(modes) != len(self.modes):
            raise ValueError("as many names as modes are needed")
        return Tensor(self.df.select(*[F.col(a).alias(b) for a, b in zip(self.modes, modes, strict=True)], VAL), tuple(modes), self.shape)

    def map(self, val: Column) -> Tensor:
        return replace(self, df=self.df.select(*self.modes, val.alias(VAL)))

    def keep(self, condition: Column) -> Tensor:
        return replace(self, df=self.df.filter(condition))


def tensor(df: DataFrame, modes: Sequence[str], val: str | Column = VAL, shape: Sequence[int] | None = None) -> Tensor:
    """A tensor from columns of a DataFrame."""
    value = F.col(val) if isinstance(val, str) else val
    return Tensor(df.select(*[F.col(m).cast("long").alias(m) for m in modes], value.alias(VAL)), tuple(modes), None if shape is None else tuple(shape))


def from_rows(spark: SparkSession, rows: Sequence[tuple], modes: Sequence[str], shape: Sequence[int] | None = None, kind: str = "long") -> Tensor:
    """A tensor from a few rows of coordinates and a value."""
    schema = ", ".join([f"{m} long" for m in modes] + [f"{VAL} {kind}"])
    return Tensor(spark.createDataFrame([tuple(r) for r in rows], schema), tuple(modes), None if shape is None else tuple(shape))


def with_inferred_shape(t: Tensor) -> Tensor:
    """The shape as greatest coordinate + 1, where a source tells none."""
    top = t.df.agg(*[F.max(m).alias(m) for m in t.modes]).first()
    return replace(t, shape=tuple((top[m] if top[m] is not None else -1) + 1 for m in t.modes))
