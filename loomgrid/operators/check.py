"""Comparison of results and checks of formats."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tensor import VAL, Tensor


def compare(t: Tensor, gold: Tensor, err: float = 1e-12) -> DataFrame:
    """One row: entries of each side (stored zeros don't count), mismatches, and whether all is equal.

    Values may differ by max(abs(a) * err, err); a coordinate on one side only is a mismatch.
    """
    both = _compared(t, gold, list(t.modes), err)
    return both.agg(F.count("a").alias("entries"), F.count("b").alias("gold_entries"), F.count_if("bad").alias("mismatches")).withColumn("equal", F.col("mismatches") == 0)


def _compared(t: Tensor, gold: Tensor, on: Sequence[str], err: float) -> DataFrame:
    a = t.df.filter(F.col(VAL) != 0).select(*on, F.col(VAL).alias("a"))
    b = gold.df.filter(F.col(VAL) != 0).select(*on, F.col(VAL).alias("b"))
    far = F.abs(F.col("a") - F.col("b")) > F.greatest(F.abs("a") * err, F.lit(err))
    both = a.join(b, list(on), "full_outer") if on else a.join(b, F.lit(True), "full_outer")
    return both.withColumn("bad", F.coalesce(far, F.lit(True)))


def compare_tiled(parts: Tensor, gold: Tensor, tile: Sequence[str], err: float = 1e-12) -> DataFrame:
    """The same per tile; a tile that the gold lacks must hold zeros only."""
    both = _compared(parts, gold, list(parts.modes), err)
    return both.groupBy(*tile).agg(F.count("a").alias("entries"), F.count("b").alias("gold_entries"), F.count_if("bad").alias("mismatches")).withColumn("equal", F.col("mismatches") == 0)


def check_csf(crd: DataFrame, seg: DataFrame) -> DataFrame:
    """Per level, what is wrong with it: segments that don't start at 0, aren't monotone or don't end at the number of coordinates, and coordinates out of order.

    ``crd``: (level, pos, fiber, crd); ``seg``: (level, fiber, start, end). Neighbours are matched by
    fiber + 1 and pos + 1, so that no task takes a whole level.
    """
    nxt = seg.select("level", (F.col("fiber") - 1).alias("fiber"), F.col("start").alias("next"))
    joined = seg.join(nxt, ["level", "fiber"], "left")
    segments = joined.groupBy("level").agg(
        F.count_if((F.col("fiber") == 0) & (F.col("start") != 0)).alias("bad_start"),
        F.count_if((F.col("end") < F.col("start")) | F.coalesce(F.col("next") != F.col("end"), F.lit(False))).alias("not_monotone"),
        F.max("end").alias("last"),
    )
    after = crd.select("level", "fiber", (F.col("pos") - 1).alias("pos"), F.col("crd").alias("after"))
    order = crd.join(after, ["level", "fiber", "pos"], "left").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("crd") >= F.col("after")).alias("unsorted"))
    return segments.join(order, "level", "left").select("level", "bad_start", "not_monotone", F.coalesce((F.col("last") != F.coalesce("n", F.lit(0))).cast("long"), F.lit(0)).alias("bad_end"), F.coalesce("unsorted", F.lit(0)).cast("long").alias("unsorted"))


def drawn_cells(t: Tensor) -> tuple[int, int, int]:
    """Entries, distinct cells, and entries out of bounds or below 1.

    Where the cells of every partition rise and no two partitions overlap, as ``generate.random_tensor`` leaves them, all cells differ and
    nothing is shuffled: a row per partition tells. Otherwise cells are counted.
    """
    out = reduce(lambda a, b: a | b, [(F.col(m) < 0) | (F.col(m) >= n) for m, n in zip(t.modes, t.shape, strict=True)]) | (F.col(VAL) < 1)
    modes, shape = t.modes, t.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, wrong, rising, first, last = 0, 0, True, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(modes[0]).to_numpy()
            for m, size in zip(modes[1:], shape[1:], strict=True):
                cell = cell * size + batch.column(m).to_numpy()
            n += len(cell)
            wrong += batch.column("_out").true_count
            rising = rising and bool((cell[1:] > cell[:-1]).all()) and (last is None or cell[0] > last)
            first, last = int(cell[0]) if first is None else first, int(cell[-1])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (n, wrong, rising, first, last)], ["n", "wrong", "rising", "first", "last"])

    parts = []
    if prod(shape) < 1 << 62:
        parts = sorted(t.df.select(*modes, out.alias("_out")).mapInArrow(run, "n long, wrong long, rising boolean, first long, last long").collect(), key=lambda r: r["first"])
        n, wrong = sum(r["n"] for r in parts), sum(r["wrong"] for r in parts)
        if not wrong and all(r["rising"] for r in parts) and all(a["last"] < b["first"] for a, b in zip(parts, parts[1:])):
            return n, n, wrong
    got = t.df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*modes).alias("d"), F.count_if(out).alias("wrong")).first()
    return got["n"], got["d"], got["wrong"]
