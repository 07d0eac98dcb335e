"""Seeded synthetic tensors. The same arguments give the same entries, however they are partitioned."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tensor import VAL, Tensor
from .formats import DENSE_CELLS, with_position

#: Entries that a range of cells has on average, and gaps that are drawn at once.
GAPS = 4096


def _uniform(cell: Column, seed: int, salt: int = 0) -> Column:
    """A number in [0, 1) from a digest of the cell's number."""
    return F.pmod(F.xxhash64(cell, F.lit(seed), F.lit(salt)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _cells(spark: SparkSession, ids: DataFrame, modes: Sequence[str], shape: Sequence[int]) -> DataFrame:
    rest = F.col("id")
    columns = []
    for m, n in list(zip(modes, shape, strict=True))[::-1]:
        columns.append(F.pmod(rest, F.lit(n)).alias(m))
        rest = F.floor(rest / n).cast("long")
    return ids.select(*columns[::-1], *[c for c in ids.columns if c != "id"])


def _size(shape: Sequence[int]) -> int:
    return reduce(lambda a, b: a * b, shape, 1)


def random_tensor(spark: SparkSession, modes: Sequence[str], shape: Sequence[int], sparsity: float, seed: int = 0, cap: int = 255) -> Tensor:
    """Each cell is stored with probability 1 - sparsity, with a whole value in [1, cap): a stored entry isn't 0.

    Cells are drawn by the gaps between stored ones, which are geometric: a range of cells that has about GAPS entries is drawn from a
    generator of its own (seed, number of the range) until a gap leaves it. So the work is by entries, not by cells, at every size.
    """
    size, share = _size(shape), 1 - sparsity
    if size >= 1 << 62:
        raise ValueError("cells are numbered by longs")
    span = min(size, max(1, round(GAPS / share))) if share > 0 else 1
    ranges = -(-size // span) if share > 0 else 0

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                random, cells, at = np.random.Generator(np.random.Philox(key=[seed % 2**63, k])), [], -1
                end = min(span, size - k * span)
                while at < end:
                    # gaps beyond the range all leave it, whatever their length
                    steps = at + np.cumsum(np.minimum(random.geometric(share, GAPS), end + 1))
                    cells.append(steps[steps < end])
                    at = int(steps[-1])
                got = np.concatenate(cells)
                values = random.integers(1, max(cap, 2), len(got))
                yield pa.RecordBatch.from_arrays([pa.array(k * span + got), pa.array(values)], ["id", VAL])

    ids = spark.range(ranges).mapInArrow(draw, f"id long, {VAL} long")
    return Tensor(_cells(spark, ids, modes, shape), tuple(modes), tuple(shape))


def fixed_nnz(spark: SparkSession, modes: Sequence[str], shape: Sequence[int], nnz: int, seed: int = 0, cap: int | None = None) -> Tensor:
    """Exactly ``nnz`` distinct cells (all, if the shape has no more): more are drawn than needed, the first by digest stay."""
    size = _size(shape)
    if nnz * 4 >= size:
        drawn = spark.range(size)
    else:
        drawn = spark.range(int(nnz * 1.5) + 100).select(F.floor(_uniform(F.col("id"), seed, 2) * size).cast("long").alias("id")).distinct()
    ids = with_position(drawn.withColumn("_u", _uniform(F.col("id"), seed, 3)), ["_u", "id"], "_pos").filter(F.col("_pos") < nnz).select("id")
    value = F.lit(1).cast("long") if cap is None else (1 + F.floor(_uniform(F.col("id"), seed, 1) * (cap - 1))).cast("long")
    return Tensor(_cells(spark, ids.withColumn(VAL, value), modes, shape), tuple(modes), tuple(shape))


def fixed_nnz_matrix(spark: SparkSession, nnz: int, dim: int, seed: int = 0) -> Tensor:
    """A square matrix of ones at ``nnz`` distinct cells."""
    return fixed_nnz(spark, ("i", "j"), (dim, dim), nnz, seed)


def runs_vectors(spark: SparkSession, run_length: int, nnz: int, size: int = 2000) -> tuple[Tensor, Tensor]:
    """Two vectors of ``nnz`` ones: runs of one alone, then of the other alone, then a common entry, over and over."""
    groups = -(-nnz // (run_length + 1))
    period = 2 * run_length + 1
    at = F.pmod("id", F.lit(period))
    base = spark.range(min(size, groups * period)).withColumn("_at", at).withColumn("_g", F.floor(F.col("id") / period))
    one = base.filter((F.col("_at") < run_length) | (F.col("_at") == 2 * run_length))
    two = base.filter(F.col("_at") >= run_length)
    # the k-th entry of a vector, to stop at nnz
    first = F.col("_g") * (run_length + 1) + F.least(F.col("_at"), F.lit(run_length))
    second = F.col("_g") * (run_length + 1) + F.col("_at") - run_length
    make = lambda df, k: Tensor(df.filter(k < nnz).select(F.col("id").alias("i"), F.lit(1).cast("long").alias(VAL)), ("i",), (size,))
    return make(one, first), make(two, second)


def block_vectors(spark: SparkSession, nnz: int, length: int, size: int = 2000, seed: int = 0) -> tuple[Tensor, Tensor]:
    """Two vectors of ``nnz`` ones in blocks of ``length``; blocks keep apart, and those of the second are moved by up to a block."""
    blocks = -(-nnz // length)
    slot = max(size // blocks, 2 * length + 1)
    free = slot - 2 * length
    rows = spark.range(blocks).withColumn("_jit", F.floor(_uniform(F.col("id"), seed) * free).cast("long")).withColumn("_mov", F.floor(_uniform(F.col("id"), seed, 1) * (length + 1)).cast("long"))
    cells = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).filter(F.col("id") * length + F.col("_o") < nnz)
    start = F.col("id") * slot + F.col("_jit") + F.col("_o")
    make = lambda at: Tensor(cells.select(at.cast("long").alias("i"), F.lit(1).cast("long").alias(VAL)), ("i",), (max(size, blocks * slot),))
    return make(start), make(start + F.col("_mov"))


def _every_cell(spark: SparkSession, modes: Sequence[str], shape: Sequence[int], cells: int) -> DataFrame:
    if _size(shape) > cells:
        raise ValueError(f"{_size(shape)} cells; raise the limit to make them")
    return _cells(spark, spark.range(_size(shape)), modes, shape)


def dense_ramp(spark: SparkSession, modes: Sequence[str], shape: Sequence[int], order: str = "row", cells: int = DENSE_CELLS) -> Tensor:
    """A dense matrix of rising values: cell (a, b) holds a * columns + b, or by columns b * rows + a. More than ``cells`` are refused."""
    a, b = modes
    value = F.col(a) * shape[1] + F.col(b) if order == "row" else F.col(b) * shape[0] + F.col(a)
    return Tensor(_every_cell(spark, modes, shape, cells).select(a, b, value.alias(VAL)), tuple(modes), tuple(shape))


def dense_ones(spark: SparkSession, modes: Sequence[str], shape: Sequence[int], cells: int = DENSE_CELLS) -> Tensor:
    """A dense tensor of ones; more than ``cells`` cells are refused."""
    return Tensor(_every_cell(spark, modes, shape, cells).withColumn(VAL, F.lit(1).cast("long")), tuple(modes), tuple(shape))


def other_vector(spark: SparkSession, mode: str, dim: int, density: float = 0.25, seed: int = 0) -> Tensor:
    """A sparse vector of ones."""
    return random_tensor(spark, (mode,), (dim,), 1 - density, seed).map(F.lit(1).cast("long"))


def other_matrix(spark: SparkSession, modes: Sequence[str], dim: int, rows: int = 10, density: float = 0.25, seed: int = 0) -> Tensor:
    """A sparse matrix of ones with few rows."""
    return random_tensor(spark, modes, (rows, dim), 1 - density, seed).map(F.lit(1).cast("long"))
