"""Products of matrices through packed tiles: tiles that share the contracted tile are one row of arrays, a strip; a pair of strips is one row of a join.

A strip holds about STRIP entries, however sparse the tiles are: all tiles of one contracted tile, or a digest's share of them where they have more. So
pairs of tiles that have no product cost nothing. The pairs of an Arrow batch are multiplied together in numpy: by matching entries, or as dense blocks
where a pair has more products than cells. So neither entries nor pairs of tiles become rows of a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import VAL, Tensor
from . import rowblocks
from .rowblocks import WHOLE, combined, ragged

#: Partial products that are worked on at once in a task; output cells that it sums in memory before it sends them on; entries of a strip; pairs that share their numbers.
PRODUCTS, HELD, STRIP, PAIRS = 1 << 20, 1 << 21, 1 << 12, 256


def strip_pairs(b: Tensor, c: Tensor, size: int) -> tuple[DataFrame, tuple[str, str, str]]:
    """Strips of both matrices joined on the contracted tile: its number ``_t``, entries ``_b`` (row, local k, val) and ``_c`` (local k, column, val), and (i, k, j)."""
    (k,) = [m for m in b.modes if m in c.modes]
    i, j = next(m for m in b.modes if m != k), next(m for m in c.modes if m != k)
    tile = F.floor(F.col(k) / size).cast("long").alias("_t")
    local = F.pmod(k, F.lit(size)).alias("_k")
    x, y = b.df.select(tile, F.col(i).alias("_at"), local, VAL), c.df.select(tile, F.col(j).alias("_at"), local, VAL)
    parts = lambda df, name: df.groupBy("_t").agg(F.ceil(F.count(F.lit(1)) / STRIP).cast("int").alias(name))
    # entries / STRIP rows of either side at most
    grid = F.broadcast(parts(x, "_rows").join(parts(y, "_columns"), "_t").filter("_rows > 1 OR _columns > 1"))
    one = lambda name: F.coalesce(F.col(name), F.lit(1))

    def strips(df: DataFrame, own: str, other: str, at: str, across: str, out: str) -> DataFrame:
        number = F.pmod(F.xxhash64(F.floor(F.col("_at") / size), F.lit(1)), one(own)).cast("int")
        rows = df.join(grid, "_t", "left").select("_t", "_at", "_k", VAL, number.alias(at), one(other).alias("_n"))
        packed = rows.groupBy("_t", at, "_n").agg(F.collect_list(F.struct("_at", "_k", VAL)).alias(out))
        return packed.select("_t", at, out, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias(across))

    met = strips(x, "_rows", "_columns", "_r", "_q", "_b").join(strips(y, "_columns", "_rows", "_q", "_r", "_c"), ["_t", "_r", "_q"])
    return met.select("_t", "_b", "_c"), (i, k, j)


def _entries(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Offsets and flat fields of a column of arrays of structs."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], [f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten()]


def _dense(bi: np.ndarray, bk: np.ndarray, bv: np.ndarray, ck: np.ndarray, cj: np.ndarray, cv: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and sum of the cells that have a product, of one pair as dense blocks."""
    (rows, bi), (columns, cj) = np.unique(bi, return_inverse=True), np.unique(cj, return_inverse=True)
    (x, p), (y, q) = (tuple(np.zeros(shape, t) for t in (np.float64, np.float32)) for shape in ((len(rows), size), (size, len(columns))))
    np.add.at(x, (bi, bk), bv)
    np.add.at(y, (ck, cj), cv)
    p[bi, bk] = q[ck, cj] = 1
    cells = np.flatnonzero((p @ q).ravel())
    return rows[cells // len(columns)], columns[cells % len(columns)], (x @ y).ravel()[cells]


def products(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, row, column, value) of all pairs of a batch, each cell of a pair once."""
    for at in range(0, batch.num_rows, PAIRS):
        for pair, *cells in _products(batch.slice(at, PAIRS), size):
            yield pair + at, *cells


def _products(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    (bo, (bi, bk, bv)), (co, (cj, ck, cv)) = (_entries(batch.column(c)) for c in ("_b", "_c"))
    n = batch.num_rows
    b_pair, c_pair = np.repeat(np.arange(n), np.diff(bo)), np.repeat(np.arange(n), np.diff(co))
    order, count = np.argsort(c_pair * size + ck, kind="stable"), np.bincount(c_pair * size + ck, minlength=n * size)
    first, made = np.cumsum(count) - count, count[b_pair * size + bk]
    total = np.bincount(b_pair, weights=made, minlength=n)
    (rows, bi_at), (columns, cj_at) = np.unique(bi, return_inverse=True), np.unique(cj, return_inverse=True)
    # sums of whole numbers as doubles are exact below 2**53
    most = float(np.abs(bv).max(initial=0)) * float(np.abs(cv).max(initial=0)) * size
    exact = bv.dtype.kind == "f" or cv.dtype.kind == "f" or most < 2.0**53
    dense = np.zeros(n, bool)
    for r in np.flatnonzero(total > STRIP) if exact else ():
        x, y = slice(bo[r], bo[r + 1]), slice(co[r], co[r + 1])
        if total[r] > len(np.unique(bi_at[x])) * len(np.unique(cj_at[y])):
            i, j, values = _dense(bi[x], bk[x], bv[x], ck[y], cj[y], cv[y], size)
            dense[r] = True
            yield np.full(len(i), r), i, j, values.astype(np.result_type(bv, cv))
    made[dense[b_pair]] = 0
    upto = np.cumsum(np.where(dense, 0, total))
    a = 0
    while a < n:
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PRODUCTS, "right")))
        s = slice(bo[a], bo[z])
        m = made[s]
        at = order[ragged(first[(b_pair * size + bk)[s]], m)]
        key = np.repeat((b_pair[s] * len(rows) + bi_at[s]) * len(columns), m) + cj_at[at]
        key, values = combined(key, np.repeat(bv[s], m) * cv[at])
        row = key // len(columns)
        yield row // len(rows), rows[row % len(rows)], columns[key % len(columns)], values
        a = z


def _alike(b: Tensor, c: Tensor) -> tuple[Tensor, Tensor, str]:
    """Both with the same kind of value: long if both are whole, else double."""
    kind = "bigint" if all(dict(t.df.dtypes)[VAL] in WHOLE for t in (b, c)) else "double"
    return b.map(F.col(VAL).cast(kind)), c.map(F.col(VAL).cast(kind)), kind


def partials(b: Tensor, c: Tensor, levels: Sequence[int]) -> Tensor:
    """The product of every pair of tiles: all tile numbers, local coordinates, value. All products of a pair of tiles are in one pair of strips, so no sum follows."""
    b, c, kind = _alike(b, c)
    size, depth = levels[-1], len(levels)
    pairs, (i, k, j) = strip_pairs(b, c, size)
    own = [[m + "0" * (depth - n) for m in t.modes] for t in (b, c) for n in range(depth)]
    ids = list(dict.fromkeys(name for names in own for name in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = batch.column("_t").to_numpy()
            for pair, row, column, values in products(batch, size):
                for a in range(0, len(pair), 1 << 16):
                    s = slice(a, a + (1 << 16))
                    rest, out = {i: row[s], k: tile[pair[s]] * size, j: column[s]}, {}
                    for n in range(depth):
                        factor = prod(levels[n:])
                        for m in rest:
                            out[m + "0" * (depth - n)], rest[m] = np.divmod(rest[m], factor)
                    yield pa.RecordBatch.from_arrays([*[pa.array(out[m]) for m in ids], pa.array(rest[i]), pa.array(rest[j]), pa.array(values[s])], [*ids, i, j, VAL])

    schema = ", ".join(f"`{m}` long" for m in (*ids, i, j)) + f", {VAL} {kind}"
    return Tensor(pairs.mapInArrow(run, schema), (*ids, i, j))


def units(b: Tensor, c: Tensor, levels: Sequence[int], blocks: int) -> DataFrame:
    """What ``rowblocks.summed`` sums: (_block, _i, _x, _p), rows of partial results, summed in a task as far as HELD cells go."""
    b, c, _ = _alike(b, c)
    size = levels[-1]
    pairs, _ = strip_pairs(b, c, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows, columns, values = (np.concatenate(x) for x in zip(*held, strict=True))
            low, width = int(columns.min()), int(columns.max() - columns.min()) + 1
            if int(rows.max()) * width < 1 << 62:
                key, values = combined(rows * width + (columns - low), values)
                return key // width, key % width + low, values
            order = np.lexsort((columns, rows))
            rows, columns = rows[order], columns[order]
            new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])])
            return rows[new], columns[new], np.add.reduceat(values[order], new)

        def packed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            own = rows[starts]
            block = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(blocks)
            parts = pa.array(rowblocks.pack(np.r_[starts, len(rows)], columns, values), pa.binary())
            alone = np.arange(len(own) + 1, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(alone, pa.array(x)) for x in (own, np.ones(len(own), values.dtype))]
            whole = pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), *lists, parts], ["_block", "_i", "_x", "_p"])
            yield from (whole.slice(a, 4096) for a in range(0, len(own), 4096))

        for batch in batches:
            for _, rows, columns, values in products(batch, size):
                if len(rows):
                    held.append((rows, columns, values))
                    n += len(rows)
                if n > HELD:
                    now = merged()
                    if len(now[0]) > HELD // 2:  # little meets: what is there goes on
                        yield from packed(*now)
                        held, n = [], 0
                    else:
                        held, n = [now], len(now[0])
        if held:
            yield from packed(*merged())

    kind = dict(b.df.dtypes)[VAL]
    return pairs.mapInArrow(run, f"_block long, _i array<long>, _x array<{kind}>, _p binary")


def summed(b: Tensor, c: Tensor, levels: Sequence[int], by_entry: Callable[[Tensor, Tensor], DataFrame]) -> Tensor:
    """X(i, j) with global coordinates, without zeros: partial results go packed to blocks of result rows. Rows that are too wide for a task are summed ``by_entry``."""
    shape = None if b.shape is None or c.shape is None else (b.shape, c.shape)
    b, c, _ = _alike(b, c)
    (k,) = [m for m in b.modes if m in c.modes]
    i, j = next(m for m in b.modes if m != k), next(m for m in c.modes if m != k)
    got = rowblocks.summed(b, c, lambda x, y, n, _: units(x, y, levels, n), by_entry)
    return Tensor(got, (i, j), None if shape is None else (b.dim(i), c.dim(j)))
