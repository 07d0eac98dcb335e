"""The tensor expressions that jobs run. Formats fix only layout; the answer depends on the expression alone.

Products are equi-joins on shared variables, sums are aggregations that combine before they
shuffle. Small factors are broadcast by Spark's own size check; nothing is hinted. Results
keep zeros that cancelled; ``drop_zeros`` makes them canonical.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import elementwise, joins, reductions, stats
from ..operators.elementwise import drop_zeros
from ..tensor import VAL, Tensor
from . import blocks, rowblocks


def product(a: Tensor, b: Tensor) -> Tensor:
    """Values multiplied where the shared variables agree; all variables stay.

    Without a shared variable every pair of entries is a result; more than ``joins.PAIRS`` are refused.
    """
    shared = [m for m in a.modes if m in b.modes]
    modes = (*a.modes, *[m for m in b.modes if m not in a.modes])
    if not shared and a.modes and b.modes:
        joins.guard_pairs(a.df, b.df)
    x, y = a.df.select(*a.modes, F.col(VAL).alias("_x")), b.df.select(*b.modes, F.col(VAL).alias("_y"))
    both = x.join(y, shared) if shared else x.join(y, F.lit(True))
    sizes = dict(zip(a.modes, a.shape or [None] * a.order, strict=True)) | dict(zip(b.modes, b.shape or [None] * b.order, strict=True))
    shape = tuple(sizes[m] for m in modes)
    return Tensor(both.select(*modes, (F.col("_x") * F.col("_y")).alias(VAL)), modes, None if None in shape else shape)


def contract(a: Tensor, b: Tensor, out: Sequence[str]) -> Tensor:
    """The product summed over all variables that aren't in ``out``."""
    p = product(a, b)
    summed = reductions.reduce_modes(p, [m for m in p.modes if m not in out])
    return elementwise.permute_modes(summed, [summed.modes.index(m) for m in out]) if out else summed


def elemmul(b: Tensor, c: Tensor) -> Tensor:
    """X = B * C, for vectors, matrices and 3-tensors."""
    return drop_zeros(product(b, c))


def elemadd(*tensors: Tensor) -> Tensor:
    """X = B + C + ..."""
    return drop_zeros(joins.union_all_n(tensors))


def mat_vecmul(b: Tensor, c: Tensor) -> Tensor:
    """x(i) = sum over j of B(i, j) c(j)."""
    return drop_zeros(contract(b, c, b.modes[:1]))


#: Loop orders by the flow that has their outermost data: columns of B times rows of C, rows of C per entry of B, columns of B per entry of C.
FLOWS = {"kij": "outer", "kji": "outer", "ikj": "rows", "ijk": "rows", "jki": "columns", "jik": "columns"}
#: Heavy coordinates have more than this share of a task's part of the products; a row of C is packed in segments of this many columns.
HEAVY, SEGMENT = 0.25, 1 << 12


def heavy_coordinates(b: Tensor, c: Tensor, tasks: int, share: float = HEAVY) -> DataFrame:
    """Contracted coordinates with more products than ``share`` of an even task's, and the grid they are cut to: k, rows, columns.

    There are ``tasks / share`` such coordinates at most. Parts of a grid have about as many products
    as the threshold; its sides are in proportion to the entries that B and C have there, so that as few as possible are repeated.
    """
    (k,) = [m for m in b.modes if m in c.modes]
    cost = stats.matmul_cost(b, c)
    limit = cost.agg((F.sum("products") * share / tasks).alias("_limit"))
    parts = F.col("products") / F.col("_limit")
    rows = F.least(F.greatest(F.round(F.sqrt(parts * F.col("b_count") / F.col("c_count"))), F.lit(1)), F.col("b_count"))
    heavy = cost.join(F.broadcast(limit)).filter(F.col("products") > F.col("_limit")).withColumn("_rows", rows.cast("int"))
    columns = F.least(F.ceil(parts / F.col("_rows")), F.col("c_count"))
    return heavy.select(k, "_rows", columns.cast("int").alias("_columns"))


def spread(b: Tensor, c: Tensor, share: float = HEAVY) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both factors with a cell (_r, _c) of their coordinate's grid, and the keys to join on.

    Rows of B go to a grid row and are repeated along it, columns of C likewise; coordinates that aren't heavy are one cell.
    """
    (k,) = [m for m in b.modes if m in c.modes]
    i, j = next(m for m in b.modes if m != k), next(m for m in c.modes if m != k)
    tasks = int(b.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_coordinates(b, c, tasks, share))  # tasks / share rows at most
    one = lambda name: F.coalesce(F.col(name), F.lit(1))
    # another seed than the shuffle's, so that a grid's cells don't share its choice of partitions
    own = lambda mode, name: F.pmod(F.xxhash64(mode, F.lit(1)), one(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), one(name) - 1))
    x = b.df.select(k, i, F.col(VAL).alias("_x")).join(heavy, k, "left").select(k, i, "_x", own(i, "_rows").alias("_r"), every("_columns").alias("_c"))
    y = c.df.select(k, j, F.col(VAL).alias("_y")).join(heavy, k, "left").select(k, j, "_y", own(j, "_columns").alias("_c"), every("_rows").alias("_r"))
    return x, y, [k, "_r", "_c"]


def products(b: Tensor, c: Tensor, flow: str = "outer", share: float = HEAVY) -> DataFrame:
    """Partial products (i, j, val), not yet summed, without a task that a popular k fills."""
    (k,) = [m for m in b.modes if m in c.modes]
    i, j = next(m for m in b.modes if m != k), next(m for m in c.modes if m != k)
    if flow == "columns":
        return products(Tensor(c.df, (j, k)), Tensor(b.df, (k, i)), "rows", share).select(i, j, VAL)
    x, y, keys = spread(b, c, share)
    if flow == "outer":
        return x.join(y, keys).select(i, j, (F.col("_x") * F.col("_y")).alias(VAL))
    # rows of C as arrays of bounded length: a row of the join for each entry of B and segment, not for each product
    packed = y.groupBy(*keys, F.floor(F.col(j) / SEGMENT).alias("_seg")).agg(F.collect_list(F.struct(j, "_y")).alias("_row"))
    met = x.join(packed, keys).select(i, "_x", F.explode("_row").alias("_e"))
    return met.select(i, F.col("_e")[j].alias(j), (F.col("_x") * F.col("_e._y")).alias(VAL))


def matmul(b: Tensor, c: Tensor, order: str = "kij", share: float = HEAVY) -> Tensor:
    """X(i, j) = sum over k of B(i, k) C(k, j) in any of the six loop orders.

    With k outermost, columns of B meet rows of C entry by entry; with i (j) outermost every entry of B (of C) meets whole rows of the other in
    segments. In every order the products per k are counted first, and a heavy k is spread over a grid of
    rows and columns, so that no task waits for it.
    """
    (k,) = [m for m in b.modes if m in c.modes]
    i, j = next(m for m in b.modes if m != k), next(m for m in c.modes if m != k)
    shape = None if b.shape is None or c.shape is None else (b.dim(i), c.dim(j))
    return Tensor(summed(b, c, FLOWS[order], share), (i, j), shape)


def summed(b: Tensor, c: Tensor, flow: str = "outer", share: float = HEAVY, entries: bool = False, mask: Tensor | None = None) -> DataFrame:
    """Sums of the products by blocks of result rows (``rowblocks``; for "columns" of result columns), without those that are 0.

    Only whole and floating values are packed; others are summed entry by entry.
    """
    (k,) = [m for m in b.modes if m in c.modes]
    i, j = next(m for m in b.modes if m != k), next(m for m in c.modes if m != k)
    by_entry = lambda x, y: products(x, y, "outer", share).groupBy(i, j).agg(F.sum(VAL).alias(VAL))
    if any(dict(t.df.dtypes)[VAL] not in (*rowblocks.WHOLE, "float", "double") for t in (b, c)):
        got = by_entry(b, c).filter(F.col(VAL) != 0)
        if mask is not None:
            return product(mask, Tensor(got, (i, j))).rows
        return got.groupBy(i).agg(F.count(F.lit(1)).alias("entries")) if entries else got
    if flow == "columns" and not entries:
        return summed(Tensor(c.df.select(j, k, VAL), (j, k)), Tensor(b.df.select(k, i, VAL), (k, i)), "rows", share).select(i, j, VAL)
    return rowblocks.summed(b, c, lambda x, y, n, kind: rowblocks.units(x, y, flow == "outer", grid(x, y, share, n), n, kind), by_entry, entries, mask)


def grid(b: Tensor, c: Tensor, share: float, n: int) -> DataFrame:
    """Parts of coordinates that are heavy, whose rows of C are longer than a packed row, or that B has more than once in each of ``n`` blocks: k, _rows, _columns."""
    (k,) = [m for m in b.modes if m in c.modes]
    tasks = int(b.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    y = c.df.groupBy(k).agg(F.ceil(F.count(F.lit(1)) / rowblocks.SEGMENT).cast("int").alias("_columns")).filter("_columns > 1")  # entries / SEGMENT rows at most
    x = b.df.groupBy(k).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= max(2 * n, 16)).select(k, F.lit(1), F.lit(1))
    both = heavy_coordinates(b, c, tasks, share).union(y.select(k, F.lit(1), "_columns")).union(x)
    return both.groupBy(k).agg(F.max("_rows").alias("_rows"), F.max("_columns").alias("_columns"))


def output_cost(b: Tensor, c: Tensor) -> DataFrame:
    """Partial products of every entry of the product: i, j, products."""
    (k,) = [m for m in b.modes if m in c.modes]
    ones = [t.map(F.lit(1).cast("long")) for t in (b, c)]
    keys = [m for t in (b, c) for m in t.modes if m != k]
    return summed(*ones).select(*keys, F.col(VAL).alias("products"))


def output_entries(b: Tensor, c: Tensor) -> DataFrame:
    """Entries of every row of the product, cancelled ones included, counted: i, entries. ``stats.product_rows`` estimates them."""
    return summed(*[t.map(F.lit(1).cast("long")) for t in (b, c)], entries=True)


#: Coordinates of a segment of a dense row; slots of an array that is summed as columns.
WIDTH = 64


def in_slots(t: Tensor, by: Sequence[str], mode: str, width: int = WIDTH) -> DataFrame:
    """(by, _seg, _v): the values along ``mode`` in arrays of ``width`` slots, slot mode mod width of segment mode div width; 0 where nothing is stored.

    No row is longer than ``width``, however long the fiber; only segments with entries exist.
    """
    zero = F.lit(0).cast(dict(t.df.dtypes)[VAL])
    slot = F.pmod(F.col(mode), F.lit(width)).cast("int")
    rows = t.df.groupBy(*by, F.floor(F.col(mode) / width).cast("long").alias("_seg")).agg(F.map_from_entries(F.collect_list(F.struct(slot, VAL))).alias("_m"))
    return rows.select(*by, "_seg", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda s: F.coalesce(F.try_element_at("_m", s), zero)).alias("_v"))


def sum_slots(df: DataFrame, by: Sequence[str], values: F.Column, width: int, mode: str) -> DataFrame:
    """Sums of arrays slot by slot per (by, _seg), which combine before they shuffle; as rows (by, mode, val) without zeros."""
    rows = df.select(*by, "_seg", values.alias("_v"))
    sums = rows.groupBy(*by, "_seg").agg(*[F.sum(F.col("_v")[s]).alias(f"_{s}") for s in range(width)])
    cells = sums.select(*by, "_seg", F.posexplode(F.array(*[f"_{s}" for s in range(width)])).alias("_s", VAL))
    return cells.filter(F.col(VAL) != 0).select(*by, (F.col("_seg") * width + F.col("_s")).alias(mode), VAL)


def mat_sddmm(b: Tensor, c: Tensor, d: Tensor, width: int = WIDTH) -> Tensor:
    """X(i, j) = B(i, j) * sum over k of C(i, k) D(k, j), with C and D dense: a dot product per entry of B and segment of k, then their sum.

    Rows of C and columns of D are arrays of ``width`` slots, so a long row is many rows; the slots line up by
    coordinate, stored or not.
    """
    i, j = b.modes
    (k,) = [m for m in c.modes if m != i]
    rows, cols = in_slots(c, [i], k, width).withColumnRenamed("_v", "_c"), in_slots(d, [j], k, width).withColumnRenamed("_v", "_d")
    times = F.zip_with("_c", "_d", lambda x, y: x * y)
    dot = F.aggregate(times, F.lit(0).cast(dict(c.df.dtypes)[VAL]), lambda s, x: s + x)
    parts = b.df.join(rows, i).join(cols, [j, "_seg"]).select(i, j, (F.col(VAL) * dot).alias(VAL))
    return drop_zeros(Tensor(parts.groupBy(i, j).agg(F.sum(VAL).alias(VAL)), (i, j), b.shape))


def mat_sddmm_unfused(b: Tensor, c: Tensor, d: Tensor) -> Tensor:
    """The same with the whole C * D first: only to check the other. Blocks of its rows meet the mask's rows where they are summed."""
    if len({*[dict(t.df.dtypes)[VAL] in rowblocks.WHOLE for t in (b, c, d)]}) > 1 or b.modes[0] not in c.modes:
        return elemmul(b, matmul(c, d))
    return drop_zeros(Tensor(summed(c, d, mask=b), b.modes, b.shape))


def mat_residual(b: Tensor, c: Tensor, d: Tensor) -> Tensor:
    """x(i) = b(i) - sum over j of C(i, j) d(j)."""
    return elemadd(b, elementwise.negate(contract(c, d, b.modes)))


def mat_mattransmul(c: Tensor, d: Tensor, f: Tensor, alpha: float = 2, beta: float = 2) -> Tensor:
    """x(i) = alpha * sum over j of C(j, i) d(j) + beta * f(i)."""
    return elemadd(elementwise.scalar_mul(alpha, contract(c, d, f.modes)), elementwise.scalar_mul(beta, f))


def tensor3_innerprod(b: Tensor, c: Tensor) -> Tensor:
    """x = sum of B(i, j, k) C(i, j, k)."""
    return contract(b, c, ())


def tensor3_ttv(b: Tensor, c: Tensor) -> Tensor:
    """X(i, j) = sum over k of B(i, j, k) c(k)."""
    return drop_zeros(contract(b, c, b.modes[:2]))


def _slots(t: Tensor, mode: str, width: int) -> int:
    """Slots that arrays along ``mode`` need: no more than it has coordinates, where that is known."""
    return width if t.shape is None else min(width, max(t.dim(mode), 1))


def tensor3_ttm(b: Tensor, c: Tensor, width: int = WIDTH) -> Tensor:
    """X(i, j, k) = sum over l of B(i, j, l) C(k, l).

    C's columns are arrays over k, so an entry of B is one row of the join and of the shuffle for each segment of k, not for each k.
    """
    (i, j, l), (k, _) = b.modes, c.modes  # noqa: E741
    n = _slots(c, k, width)
    both = b.df.join(in_slots(c, [l], k, n), l)
    out = sum_slots(both, [i, j], F.transform("_v", lambda v: v * F.col(VAL)), n, k)
    return Tensor(out, (i, j, k), None if b.shape is None or c.shape is None else (*b.shape[:2], c.dim(k)))


def tensor3_mttkrp(b: Tensor, c: Tensor, d: Tensor, width: int = WIDTH) -> Tensor:
    """X(i, j) = sum over k, l of B(i, k, l) C(j, k) D(j, l).

    Both factors are arrays over j: an entry of B meets one array of each for every segment of j, and arrays are summed slot by slot, so the rows
    that are shuffled don't grow with j inside a segment.
    """
    (i, k, l), (j, _) = b.modes, c.modes  # noqa: E741
    n = _slots(c, j, width)
    x, y = in_slots(c, [k], j, n).withColumnRenamed("_v", "_c"), in_slots(d, [l], j, n).withColumnRenamed("_v", "_d")
    both = b.df.join(x, k).join(y, [l, "_seg"])
    out = sum_slots(both, [i], F.zip_with("_c", "_d", lambda p, q: p * q * F.col(VAL)), n, j)
    return Tensor(out, (i, j), None if b.shape is None or c.shape is None else (b.dim(i), c.dim(j)))


def matmul_tile_partials(b: Tensor, c: Tensor, levels: Sequence[int] = (16, 128)) -> Tensor:
    """Products per pair of tiles, not yet summed over the contracted tiles."""
    return blocks.partials(b, c, levels)


def matmul_tiled(b: Tensor, c: Tensor, levels: Sequence[int] = (16, 128)) -> Tensor:
    """The product through tiles: packed tiles are paired and multiplied, then summed over the contracted tiles, with global coordinates."""
    (k,) = [m for m in b.modes if m in c.modes]
    i, j = next(m for m in b.modes if m != k), next(m for m in c.modes if m != k)
    by_entry = lambda x, y: products(x, y).groupBy(i, j).agg(F.sum(VAL).alias(VAL))
    return blocks.summed(b, c, levels, by_entry)
