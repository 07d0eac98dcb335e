"""Storage formats as tables: positions, compressed rows, compressed fibers, dense."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged
from ..tensor import VAL, Tensor

#: Keys in one block of a running sum.
BLOCK = 1 << 16
#: Cells up to which a dense form is made without being asked twice.
DENSE_CELLS = 50_000_000


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """A dense number, from 0, of every row in the given order, without a window over all rows.

    Rows are dealt by range, sorted, numbered in their partition and staged with both numbers, so that
    one shuffle is enough; the counts (one per partition) give the offsets.
    """
    cols = [F.col(c) for c in order]
    dealt = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    # the low 33 bits of the growing number count a partition's rows, in the order they have by then
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = staged(dealt.sortWithinPartitions(*cols).withColumns({"_part": F.spark_partition_id(), "_k": row}), "ranges")
    counts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return kept.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_k")).alias(name))


def running_sum(df: DataFrame, key: str, value: str | Column, name: str = "before", block: int = BLOCK, fiber: Sequence[str] = ()) -> DataFrame:
    """The sum of ``value`` over smaller keys (of the same fiber), for keys from 0 without repeats: sums per block, then within.

    No task holds more than a block of a fiber; one row per block is summed along each fiber.
    """
    rows = df.withColumns({"_block": F.floor(F.col(key) / block), "_value": F.col(value) if isinstance(value, str) else value})
    sums = rows.groupBy(*fiber, "_block").agg(F.sum("_value").alias("s"))
    along = Window.partitionBy(*fiber).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*fiber, "_block", F.coalesce(F.sum("s").over(along), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy(*fiber, "_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", inside).join(before, [*fiber, "_block"]).select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def to_coo(t: Tensor, transposed: bool = False) -> DataFrame:
    """Stored entries in order of their coordinates, first or last mode first."""
    return t.rows.orderBy(*(t.modes[::-1] if transposed else t.modes))


def to_csr(t: Tensor) -> tuple[DataFrame, DataFrame]:
    """Row pointers (row 0 to dim: row, ptr), empty rows included, and entries (pos, crd, val)."""
    i, j = t.modes
    dim = t.dim(i)
    counts = t.df.groupBy(F.col(i).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    every = t.df.sparkSession.range(dim + 1).withColumnRenamed("id", "row").join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).alias("n"))
    ptr = running_sum(every, "row", "n", "ptr").select("row", F.col("ptr").cast("long").alias("ptr"))
    return ptr, with_position(t.rows, [i, j]).select("pos", F.col(j).alias("crd"), VAL)


def to_csc(t: Tensor) -> tuple[DataFrame, DataFrame]:
    """The same by column."""
    i, j = t.modes
    return to_csr(Tensor(t.df.select(j, i, VAL), (j, i), None if t.shape is None else t.shape[::-1]))


def _level_numbers(n_modes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Along the sorted rows of a partition: which levels a row begins a node of, and the number of its node there, counted in the partition."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, seen = None, np.full(n_modes - 1, -1, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coords = [batch.column(l).to_numpy() for l in range(n_modes)]  # noqa: E741
            differs, more = np.zeros(batch.num_rows, bool), []
            for level in range(n_modes - 1):
                x = coords[level]
                differs = differs | np.r_[last is None or x[0] != last[level], x[1:] != x[:-1]]
                numbers = count[level] + np.cumsum(differs)
                more += [pa.array(differs), pa.array(numbers)]
                count[level] = numbers[-1]
            last = [x[-1] for x in coords]
            row = pa.array(seen + np.arange(batch.num_rows))
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, row, *more], [*batch.schema.names, "_k", *[f"{x}{l}" for l in range(n_modes - 1) for x in ("_new", "_n")]])  # noqa: E741

    return number


def numbered_levels(t: Tensor, modes: Sequence[str]) -> DataFrame:
    """Entries in order with the position of their node at every level (_p0, _p1, ...) and whether they are its first entry (_f0, ...).

    All levels come from one sort by range: nodes are numbered along each partition, and a table with a row per
    partition says how many stand before it and whether its first nodes began in the partition before.
    """
    n = len(modes)
    dealt = t.df.repartitionByRange(*modes).sortWithinPartitions(*modes).select(*modes, VAL, F.spark_partition_id().alias("_part"))
    schema = T.StructType([*dealt.schema.fields, T.StructField("_k", T.LongType()), *[T.StructField(f"{x}{l}", k) for l in range(n - 1) for x, k in (("_new", T.BooleanType()), ("_n", T.LongType()))]])  # noqa: E741
    kept = staged(dealt.mapInArrow(_level_numbers(n), schema), "levels")
    ends = F.struct(*modes)
    parts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min_by(ends, "_k").alias("_first"), F.max_by(ends, "_k").alias("_last"), *[(F.max(f"_n{l}") + 1).alias(f"_c{l}") for l in range(n - 1)])  # noqa: E741
    order = Window.orderBy("_part")
    parts = parts.withColumn("_prev", F.lag("_last").over(order))
    columns, same = [], F.lit(True)
    for level in range(n - 1):
        same = same & F.coalesce(F.col(f"_first.{modes[level]}") == F.col(f"_prev.{modes[level]}"), F.lit(False))
        columns.append(same.alias(f"_s{level}"))
    parts = parts.select("_part", "_rows", *[f"_c{l}" for l in range(n - 1)], *columns)  # noqa: E741
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = lambda l: F.col(f"_c{l}") - F.col(f"_s{l}").cast("long")  # noqa: E731, E741
    offsets = parts.select("_part", before(F.col("_rows")).alias("_before"), *[f"_s{l}" for l in range(n - 1)], *[(before(own(l)) - F.col(f"_s{l}").cast("long")).alias(f"_o{l}") for l in range(n - 1)])  # noqa: E741
    both = kept.join(F.broadcast(offsets), "_part")  # a row per partition
    level = lambda l: [(F.col(f"_o{l}") + F.col(f"_n{l}")).alias(f"_p{l}"), (F.col(f"_new{l}") & ~(F.col(f"_s{l}") & (F.col(f"_n{l}") == 0))).alias(f"_f{l}")]  # noqa: E731, E741
    leaf = [(F.col("_before") + F.col("_k")).alias(f"_p{n - 1}"), F.lit(True).alias(f"_f{n - 1}")]
    return both.select(*modes, VAL, *[c for l in range(n - 1) for c in level(l)], *leaf)  # noqa: E741


def to_csf(t: Tensor, order: Sequence[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compressed fibers: crd(level, pos, fiber, crd), seg(level, fiber, start, end), vals(pos, val).

    The distinct prefixes in order are the positions of a level; a fiber is its parent's
    position; its segment runs from its first to its last child. All levels share one sort by range.
    """
    modes = [t.modes[k] for k in (order or range(t.order))]
    rows = numbered_levels(t, modes)
    crds, segs = [], []
    for level, mode in enumerate(modes):
        fiber = F.col(f"_p{level - 1}") if level else F.lit(0).cast("long")
        nodes = rows.filter(f"_f{level}").select(F.col(f"_p{level}").alias("pos"), fiber.alias("fiber"), F.col(mode).alias("crd"))
        crds.append(nodes.select(F.lit(level).alias("level"), "pos", "fiber", "crd"))
        segs.append(nodes.groupBy("fiber").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).select(F.lit(level).alias("level"), "fiber", "start", "end"))
    return reduce(DataFrame.union, crds), reduce(DataFrame.union, segs), rows.select(F.col(f"_p{len(modes) - 1}").alias("pos"), VAL)


def full_csf(spark: SparkSession, shape: Sequence[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The compressed fibers that ``to_csf`` gives for a tensor of ones at every cell: narrow, as a position tells its coordinate and fiber."""
    crds, segs, nodes = [], [], 1
    for level, n in enumerate(shape):
        name = F.lit(level).alias("level")
        at = F.col("id")
        segs.append(spark.range(nodes if n else 0).select(name, at.alias("fiber"), (at * n).alias("start"), (at * n + n).alias("end")))
        nodes *= n
        crds.append(spark.range(nodes).select(name, at.alias("pos"), F.expr(f"id div {max(n, 1)}").alias("fiber"), F.pmod("id", F.lit(max(n, 1)).cast("long")).alias("crd")))
    vals = spark.range(nodes).select(F.col("id").alias("pos"), F.lit(1).cast("long").alias(VAL))
    return reduce(DataFrame.union, crds), reduce(DataFrame.union, segs), vals


def to_dcsr(t: Tensor) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compressed fibers of a matrix by row: only rows that aren't empty."""
    return to_csf(t)


def to_dcsc(t: Tensor) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compressed fibers of a matrix by column."""
    return to_csf(t, (1, 0))


def expanded(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """A row (keys, _pos) for each position of every span, long spans block by block, so that a root fiber is no single row or task."""
    block = F.explode(F.sequence(F.floor(F.col(start) / BLOCK), F.floor((F.col(end) - 1) / BLOCK))).alias("_block")
    parts = spans.select(*keys, start, end, block).repartition(*keys, "_block")
    first, last = F.greatest(F.col(start), F.col("_block") * BLOCK), F.least(F.col(end), (F.col("_block") + 1) * BLOCK) - 1
    return parts.select(*keys, F.explode(F.sequence(first, last)).alias("_pos"))


def by_key(positions: DataFrame, other: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """A join that never broadcasts: Spark takes expanded spans for as small as the spans are."""
    return positions.hint("merge").join(other, key)


def from_csf(crd: DataFrame, seg: DataFrame, vals: DataFrame, modes: Sequence[str], shape: Sequence[int] | None = None) -> Tensor:
    """Entries from compressed fibers (``modes`` in level order): every segment is expanded to its children."""
    frame: DataFrame | None = None
    for level, mode in enumerate(modes):
        spans = seg.filter(F.col("level") == level).filter("start < end")
        nodes_of = expanded(spans, ["fiber"], "start", "end")
        children = nodes_of.select("fiber", "_pos")
        nodes = by_key(children, crd.filter(F.col("level") == level).select(F.col("pos").alias("_pos"), F.col("crd").alias(mode)), "_pos")
        if frame is None:
            frame = nodes.select(F.col(mode), "_pos")
        else:
            frame = by_key(frame.withColumnRenamed("_pos", "fiber"), nodes, "fiber").select(*modes[: level + 1], "_pos")
    return Tensor(by_key(frame, vals.withColumnRenamed("pos", "_pos"), "_pos").select(*modes, VAL), tuple(modes), None if shape is None else tuple(shape))


def from_csr(ptr: DataFrame, entries: DataFrame, modes: Sequence[str], shape: Sequence[int] | None = None) -> Tensor:
    """Entries from row pointers; each row's span is expanded and joined on position."""
    nxt = ptr.select((F.col("row") - 1).alias("row"), F.col("ptr").alias("end"))
    spans = expanded(ptr.join(nxt, "row").filter("ptr < end").withColumnRenamed("row", modes[0]), [modes[0]], "ptr", "end").withColumnRenamed("_pos", "pos")
    return Tensor(by_key(spans, entries.withColumnRenamed("crd", modes[1]), "pos").select(*modes, VAL), tuple(modes), None if shape is None else tuple(shape))


def _flipped(t: Tensor) -> Tensor:
    return Tensor(t.df.select(*t.modes[::-1], VAL), t.modes[::-1], None if t.shape is None else t.shape[::-1])


def from_csc(ptr: DataFrame, entries: DataFrame, modes: Sequence[str], shape: Sequence[int] | None = None) -> Tensor:
    """Entries from column pointers."""
    return _flipped(from_csr(ptr, entries, modes[::-1], None if shape is None else shape[::-1]))


def from_dcsr(crd: DataFrame, seg: DataFrame, vals: DataFrame, modes: Sequence[str], shape: Sequence[int] | None = None) -> Tensor:
    """Entries of a matrix from its compressed fibers by row."""
    return from_csf(crd, seg, vals, modes, shape)


def from_dcsc(crd: DataFrame, seg: DataFrame, vals: DataFrame, modes: Sequence[str], shape: Sequence[int] | None = None) -> Tensor:
    """Entries of a matrix from its compressed fibers by column."""
    return _flipped(from_csf(crd, seg, vals, modes[::-1], None if shape is None else shape[::-1]))


def to_dense_t(t: Tensor, cells: int = DENSE_CELLS) -> DataFrame:
    """Every cell of the transposed tensor, its rows being the columns here."""
    return to_dense(_flipped(t), cells)


def to_dense(t: Tensor, cells: int = DENSE_CELLS) -> DataFrame:
    """Every cell, row-major, missing ones 0. A guard stops what is larger than ``cells``."""
    total = reduce(lambda a, b: a * b, t.shape, 1)
    if total > cells:
        raise ValueError(f"{total} cells; raise the limit to make them")
    grid, rest = t.df.sparkSession.range(total), F.col("id")
    for m, n in list(zip(t.modes, t.shape, strict=True))[::-1]:
        grid = grid.withColumn(m, F.pmod(rest, F.lit(n)))
        rest = F.floor(rest / n).cast("long")
        grid = grid.withColumn("id", rest)
        rest = F.col("id")
    return grid.select(*t.modes).join(t.rows, list(t.modes), "left").select(*t.modes, F.coalesce(VAL, F.lit(0).cast(dict(t.df.dtypes)[VAL])).alias(VAL))


def from_dense(df: DataFrame, modes: Sequence[str], shape: Sequence[int] | None = None) -> Tensor:
    """The cells that aren't 0."""
    return Tensor(df.filter(F.col(VAL) != 0).select(*modes, VAL), tuple(modes), None if shape is None else tuple(shape))


def to_fibers(t: Tensor, outer: Sequence[str], width: int = BLOCK) -> DataFrame:
    """Nested fibers in segments: per outer coordinate and ``segment`` (coordinate div width) an array of (crd, val) in order.

    A segment has ``width`` entries at most, so a fiber of any length is rows of bounded size; its
    segments in order are the whole fiber.
    """
    (inner,) = [m for m in t.modes if m not in outer]
    segment = F.floor(F.col(inner) / width).cast("long").alias("segment")
    return t.df.groupBy(*outer, segment).agg(F.sort_array(F.collect_list(F.struct(F.col(inner).alias("crd"), F.col(VAL)))).alias("fiber"))


def format_sizes(t: Tensor) -> DataFrame:
    """Array lengths of the compressed forms: per order of modes and level, coordinates and segments."""
    orders = [tuple(range(t.order))] + ([(1, 0)] if t.order == 2 else [])
    out = []
    for order in orders:
        modes = [t.modes[k] for k in order]
        n = t.df.agg(*[F.count_distinct(*modes[: k + 1]).alias(f"n{k}") for k in range(t.order - 1)], F.count(F.lit(1)).alias(f"n{t.order - 1}"))
        name = "".join("s" for _ in order) + "".join(str(k) for k in order)
        for k in range(t.order):
            seg = F.lit(2).cast("long") if k == 0 else F.col(f"n{k - 1}") + 1
            out.append(n.select(F.lit(name).alias("format"), F.lit(k).cast("long").alias("level"), F.col(f"n{k}").alias("crd_size"), seg.alias("seg_size")))
    return reduce(DataFrame.union, out)
