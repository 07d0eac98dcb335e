"""Helpers shared by the corpus operators: staged tables and vectorised work on UTF-8 bytes.

The byte helpers see a batch of texts as one ``uint8`` array plus row offsets, so that
word finding and hashing are a few numpy passes over the batch and never a Python loop
over words. Memory is bounded by the chunk size (one very long text is its own chunk).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.staging import staged  # noqa: F401

#: Bytes of text that are worked on at once inside a task.
CHUNK_BYTES = 1 << 20
#: Spark's regular expression for a word: any run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to few rows and bytes, so that a task holds little text at once.

    For applications (the registered queries, the pipeline); operators leave the session alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def is_held_out(doc_id: str = "doc_id") -> Column:
    """The held-out quarter: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- bytes


def _table(seed: int, n: int = 256) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _table(11)
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of a block of the running sum; powers of the hash base, and of its inverse modulo 2**64, inside a block.
_BLOCK = 1 << 16
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lut(*ranges: tuple[int, int]) -> np.ndarray:
    """A boolean table over byte values that is true in the given closed ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words that white space separates.
SPACE_SEPARATED = ~lut((0x20, 0x20), (0x09, 0x0D))
#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``[a, b)`` of a string column with their bytes and offsets (from 0); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary())
    arr = arr.fill_null(b"") if arr.null_count else arr
    n = len(arr)
    if not n:
        return
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + n + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a row: starts, ends, and the run number at each row's begin (one more at the end)."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs), np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begin[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by one running sum over the chunk (with powers per block, so the tables are small)."""
    n, blocks = len(data), len(data) // _BLOCK + 1
    up, down = _powers(pow(_BASE, _BLOCK, 2**64), blocks), _powers(pow(_INVERSE, _BLOCK, 2**64), blocks)
    total = np.zeros(n + 1, dtype=np.uint64)
    for q in range(blocks):
        a, b = q * _BLOCK, min((q + 1) * _BLOCK, n)
        part = total[a + 1 : b + 1]
        np.cumsum(_BYTE[data[a:b]] * _UP[: b - a], out=part)
        part *= up[q]
        part += total[a]
    return mix((total[ends] - total[starts]) * (_DOWN[starts % _BLOCK] * down[starts // _BLOCK]) + (ends - starts).astype(np.uint64))


def row_of(offs: np.ndarray) -> np.ndarray:
    """The row number of each item, from the rows' item offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def by_row_and_value(values: np.ndarray, rows: np.ndarray, stable: bool = False) -> np.ndarray:
    """The order by row, then value: a sort by value and a radix pass over the small row numbers."""
    order = np.argsort(values, kind="stable" if stable else None)
    r = rows[order]
    return order[np.argsort(r.astype(np.uint16) if len(r) and r.max() < 65536 else r, kind="stable")]


def distinct_in_rows(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values (sorted within the row) and the new offsets."""
    rows = row_of(offs)
    order = by_row_and_value(values, rows)
    v, r = values[order], rows[order]
    first = np.ones(len(v), dtype=bool)
    first[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[first], r[first]
    return v, np.searchsorted(r, np.arange(len(offs)))


def list_column(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values, type=kind))
