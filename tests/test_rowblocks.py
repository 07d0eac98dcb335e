"""Products by blocks of result rows: packed rows, sums in numpy, wide rows and popular coordinates."""

import numpy as np
import pyarrow as pa
import pytest

from loomgrid.operators import stats
from loomgrid.plans import kernels, rowblocks
from loomgrid.tensor import from_rows


def _matrices(spark, kind="long"):
    r = np.random.default_rng(4)
    x, y = (r.integers(-3, 4, shape) * (r.random(shape) < 0.3) for shape in ((50, 40), (40, 60)))
    x[:, 3], y[3], x[7] = 2, r.integers(-500, 500, 60), 1
    rows = lambda m: [(int(a), int(b), float(m[a, b]) if kind == "double" else int(m[a, b])) for a, b in zip(*np.nonzero(m))]
    return x, y, from_rows(spark, rows(x), ["i", "k"], x.shape, kind), from_rows(spark, rows(y), ["k", "j"], y.shape, kind)


def _sums(df):
    return {(r["i"], r["j"]): r[2] for r in df.collect()}


def _gold(p):
    return {(int(i), int(j)): p[i, j] for i, j in zip(*np.nonzero(p))}


@pytest.mark.parametrize("order", ["kij", "ikj", "jki"])
def test_products_are_not_shuffled(spark, order):
    x, y, b, c = _matrices(spark)
    got = kernels.matmul(b, c, order)
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and not [line for line in plan.splitlines() if "hashpartitioning(i#" in line and "j#" in line.partition("hashpartitioning")[2]]
    assert _sums(got.df) == _gold(x @ y)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_wide_rows_and_many_blocks(spark, monkeypatch, kind):
    x, y, b, c = _matrices(spark, kind)
    monkeypatch.setattr(rowblocks, "BLOCK", 64)
    monkeypatch.setattr(rowblocks, "SEGMENT", 7)
    for wide in (1, 1 << 20):
        monkeypatch.setattr(rowblocks, "WIDE", wide)
        for order in ("kij", "ikj", "jki"):
            got = kernels.matmul(b, c, order, share=0.05)
            assert _sums(got.df) == _gold(x @ y) and dict(got.df.dtypes)["val"] == {"long": "bigint"}.get(kind, kind)
    pairs = (x != 0).astype(int) @ (y != 0).astype(int)
    assert _sums(kernels.output_cost(b, c)) == _gold(pairs)
    assert {r["i"]: r["entries"] for r in kernels.output_entries(b, c).collect()} == {int(i): int(n) for i, n in enumerate((pairs > 0).sum(axis=1)) if n}


def test_entries_of_wide_results(spark):
    """A row of the product with more columns than a sketch holds is counted, not estimated."""
    b = from_rows(spark, [(0, 0, 1), (0, 1, 1), (1, 1, 1)], ["i", "k"])
    c = from_rows(spark, [(0, j, 1) for j in range(9000)] + [(1, 2 * j, 1) for j in range(9000)], ["k", "j"])
    assert {r["i"]: r["entries"] for r in kernels.output_entries(b, c).collect()} == {0: 13500, 1: 9000}
    assert {r["i"] for r in stats.product_rows(b, c).collect()} == {0, 1}


def test_packed_rows():
    r = np.random.default_rng(1)
    n = [1, 3, 200, 2, 1]
    for values in (r.integers(-(1 << 62), 1 << 62, sum(n)), r.integers(-128, 128, sum(n)), r.random(sum(n))):
        for top in (256, 70_000, 1 << 40, 1 << 62):
            offsets = np.r_[0, np.cumsum(n)]
            at = np.concatenate([r.choice(top, m, replace=False) if top < 1 << 20 else r.integers(0, top, m) for m in n])
            packed = pa.array([b"other", *rowblocks.pack(offsets, at, values)], pa.binary())[1:]
            m, got_at, got = rowblocks.unpack(packed, values.dtype)
            assert m.tolist() == n
            for a, z in zip(offsets[:-1], offsets[1:]):
                assert sorted(zip(at[a:z], values[a:z])) == sorted(zip(got_at[a:z], got[a:z]))


def test_sums_of_a_block(monkeypatch):
    r = np.random.default_rng(2)
    n = r.integers(1, 9, 40)
    start, i, x = np.cumsum(n) - n, r.integers(0, 5, 40) * 10**12, r.integers(-2, 3, 40)
    at, values = r.integers(0, 30, n.sum()) + 10**15, r.integers(-2, 3, n.sum())
    gold = {}
    for p in range(40):
        for e in range(start[p], start[p] + n[p]):
            gold[int(i[p]), int(at[e])] = gold.get((int(i[p]), int(at[e])), 0) + int(x[p] * values[e])
    gold = {k: v for k, v in gold.items() if v}
    for products in (3, 1000):
        for cells in (1, 40, 1 << 20):
            monkeypatch.setattr(rowblocks, "PRODUCTS", products)
            monkeypatch.setattr(rowblocks, "CELLS", cells)
            got = [(int(a), int(b), int(v)) for part in rowblocks.cells(i, x, start, n, at, values) for a, b, v in zip(*part)]
            assert len(got) == len(gold) and {(a, b): v for a, b, v in got} == gold


def test_sums_beyond_longs():
    """Terms beyond a long cancel; a sum beyond it is an error, not a wrong number."""
    one = np.zeros(2, np.int64)
    start, n = np.array([0, 1]), np.array([1, 1])
    x = np.array([4, 4])
    assert [v.tolist() for *_, v in rowblocks.cells(one, x, start, n, one, np.array([1 << 62, -(1 << 62)]))] == [[]]
    with pytest.raises(OverflowError):
        list(rowblocks.cells(one, x, start, n, one, np.array([1 << 62, 1 << 62])))


def test_product_rows_query_counts(spark, monkeypatch):
    """The query has an SQL that counts, so it doesn't estimate."""
    from loomgrid import queries

    b = from_rows(spark, [(0, 0, 1), (0, 1, 1)], ["i", "k"])
    c = from_rows(spark, [(0, j, 1) for j in range(5000)] + [(1, 2 * j, 1) for j in range(5000)], ["k", "j"])
    monkeypatch.setattr(queries, "_b", lambda *_: b)
    monkeypatch.setattr(queries.td, "lines", lambda *_: c)
    assert [tuple(r) for r in queries.QUERIES["c14_product_rows"](spark, "").collect()] == [(0, 7500)]


def test_strips_hold_many_tiles(spark, monkeypatch):
    """Tiles with an entry each meet as one row per contracted tile, not as a row per pair; full strips are spread and lose no pair."""
    from loomgrid.plans import blocks

    b = from_rows(spark, [(i * 16, i % 16, i + 1) for i in range(200)], ["i", "k"], (3200, 16))
    c = from_rows(spark, [(k % 16, k * 16, 1) for k in range(200)], ["k", "j"], (16, 3200))
    gold = {(a * 16, d * 16): a + 1 for a in range(200) for d in range(200) if a % 16 == d % 16}
    assert blocks.strip_pairs(b, c, 16)[0].count() == 1
    for strip in (1 << 12, 30):
        monkeypatch.setattr(blocks, "STRIP", strip)
        assert _sums(kernels.matmul_tiled(b, c, (8, 16)).df) == gold
        parts = kernels.matmul_tile_partials(b, c, (8, 16)).df.collect()
        assert {((r["i00"] * 8 + r["i0"]) * 16 + r["i"], (r["j00"] * 8 + r["j0"]) * 16 + r["j"]): r["val"] for r in parts} == gold and len(parts) == len(gold)


def test_expressions_sum_by_blocks(spark):
    """Products of two matrices inside an expression, and alone, aren't shuffled by both coordinates."""
    from loomgrid.plans.expression import evaluate

    x, y, b, c = _matrices(spark)
    s = from_rows(spark, [(j, j % 3 + 1) for j in range(60)], ["j"], (60,))
    for text, gold in (("X(i,j) = B(i,k) * C(k,j)", x @ y), ("X(i,j) = 2 * B(i,k) * s(j) * C(k,j)", 2 * (x @ y) * (np.arange(60) % 3 + 1)), ("X(j,i) = C(k,j) * B(i,k)", x @ y)):
        got = evaluate(text, {"B": b, "C": c, "s": s})
        plan = got.df._jdf.queryExecution().executedPlan().toString()
        assert "_block" in plan and not [line for line in plan.splitlines() if line.count("#") > 2 and "hashpartitioning(i#" in line and ", j#" in line.partition("hashpartitioning")[2]]
        assert _sums(got.df) == _gold(gold)
    assert _sums(evaluate("X(i,j) = B(i,k) * C(k,j) - B(i,k) * C(k,j)", {"B": b, "C": c}).df) == {}


def test_few_coordinates_have_few_blocks(spark):
    """Where all rows share the coordinates, a row of C goes to a block once, and blocks are few."""
    from loomgrid.operators import generate
    from loomgrid.plans import rowblocks as rb

    b, c = generate.dense_ones(spark, ("i", "k"), (3000, 2)), generate.dense_ones(spark, ("k", "j"), (2, 1000))
    assert rb._blocks_for(b, c, 6_000_000) == 1
    grid = {r["k"] for r in kernels.grid(b, c, 0.25, 1).collect()}
    assert grid == {0, 1}


@pytest.mark.parametrize("kind", ["long", "double"])
def test_mask_meets_sums_in_their_block(spark, monkeypatch, kind):
    """The whole product is made, but only the mask's cells leave a block."""
    x, y, b, c = _matrices(spark, kind)
    r = np.random.default_rng(8)
    m = r.integers(-2, 3, (50, 60)) * (r.random((50, 60)) < 0.2)
    mask = from_rows(spark, [(int(i), int(j), float(m[i, j]) if kind == "double" else int(m[i, j])) for i, j in zip(*np.nonzero(m))], ["i", "j"], (50, 60), kind)
    monkeypatch.setattr(rowblocks, "BLOCK", 64)
    for wide in (1, 1 << 20):
        monkeypatch.setattr(rowblocks, "WIDE", wide)
        got = kernels.mat_sddmm_unfused(mask, b, c)
        assert _sums(got.rows) == _gold(m * (x @ y))
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert "_m" in plan and not [line for line in plan.splitlines() if "hashpartitioning(i#" in line and "j#" in line.partition("hashpartitioning")[2]]
