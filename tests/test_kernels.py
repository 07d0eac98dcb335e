"""Directed kernels, random kernels against numpy, and equivalences."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.operators import check, formats, generate, stats, tiling
from loomgrid.plans import kernels
from loomgrid.plans.expression import evaluate
from loomgrid.tensor import Tensor, from_rows


def entries(t):
    return {tuple(r[:-1]): r[-1] for r in t.df.select(*t.modes, "val").collect() if r[-1] != 0}


def dense(t, shape=None):
    x = np.zeros(shape or t.shape)
    for k, v in entries(t).items():
        x[k] += v
    return x


def test_residual_and_mattransmul(spark):
    v = lambda d, m: from_rows(spark, [(k, x) for k, x in d.items()], [m], (16,))
    c = from_rows(spark, [(0, 1, 3), (2, 1, 4)], ["i", "j"], (16, 16))
    b, d = v({1: 1, 2: 2}, "i"), v({1: 5, 2: 6}, "j")
    assert entries(kernels.mat_residual(b, c, d)) == {(0,): -15, (1,): 1, (2,): -18}
    assert entries(kernels.mat_mattransmul(c, d, b)) == {(0,): 30, (1,): 2, (2,): 44}
    assert entries(evaluate("x(i) = b(i) - C(i,j) * d(j)", {"b": b, "C": c, "d": d})) == {(0,): -15, (1,): 1, (2,): -18}


def test_matmul_with_empty_rows(spark):
    a = from_rows(spark, [(1, 2, -340), (1, 3, -481), (2, 3, -30)], ["i", "k"], (4, 4))
    b = from_rows(spark, [(0, 1, -284), (0, 2, 386), (1, 2, -223), (2, 1, 707), (2, 2, 411)], ["k", "j"], (4, 4))
    assert entries(kernels.matmul(a, b)) == {(1, 1): -240380, (1, 2): -139740}


def test_elemmul_disjoint(spark):
    a = from_rows(spark, [(0, 0, 1), (1, 2, 2), (1, 3, 3), (2, 2, 4)], ["i", "j"])
    b = from_rows(spark, [(0, 1, 5), (1, 2, 6), (1, 3, 7), (3, 1, 8)], ["i", "j"])
    assert entries(kernels.elemmul(a, b)) == {(1, 2): 12, (1, 3): 21}


@pytest.mark.parametrize("seed", [0, 1])
def test_random_matrices(spark, seed):
    b = generate.random_tensor(spark, ("i", "k"), (23, 17), 0.7, seed)
    c = generate.random_tensor(spark, ("k", "j"), (17, 29), 0.6, seed + 10)
    gold = dense(b) @ dense(c)
    whole = kernels.matmul(b, c)
    assert (dense(whole, (23, 29)) == gold).all()
    for order in kernels.FLOWS:
        assert (dense(kernels.matmul(b, c, order), (23, 29)) == gold).all()
        assert (dense(kernels.matmul(b, c, order, share=0.001), (23, 29)) == gold).all()
    assert (dense(kernels.matmul_tiled(b, c, (2, 4)), (23, 29)) == gold).all()
    assert (dense(evaluate("X(i,j) = B(i,k) * C(k,j)", {"B": b, "C": c}), (23, 29)) == gold).all()
    assert check.compare(whole, kernels.matmul_tiled(b, c, (2, 4))).first()["equal"]
    m = generate.random_tensor(spark, ("i", "j"), (23, 29), 0.5, seed + 20)
    rows, cols = generate.dense_ramp(spark, ("i", "k"), (23, 8)), generate.dense_ramp(spark, ("k", "j"), (8, 29), "column")
    sddmm = dense(m) * (dense(rows) @ dense(cols))
    assert (dense(kernels.mat_sddmm(m, rows, cols)) == sddmm).all()
    assert (dense(kernels.mat_sddmm_unfused(m, rows, cols), (23, 29)) == sddmm).all()


def test_three_modes(spark):
    t = generate.random_tensor(spark, ("i", "k", "l"), (5, 6, 7), 0.6, 3)
    c = generate.random_tensor(spark, ("j", "k"), (4, 6), 0.4, 4)
    d = generate.random_tensor(spark, ("j", "l"), (4, 7), 0.4, 5)
    x, y, z = dense(t), dense(c), dense(d)
    assert (dense(kernels.tensor3_mttkrp(t, c, d), (5, 4)) == np.einsum("ikl,jk,jl->ij", x, y, z)).all()
    assert (dense(kernels.tensor3_ttm(t, d), (5, 6, 4)) == np.einsum("ikl,jl->ikj", x, z)).all()
    v = generate.random_tensor(spark, ("l",), (7,), 0.3, 6)
    assert (dense(kernels.tensor3_ttv(t, v), (5, 6)) == np.einsum("ikl,l->ik", x, dense(v))).all()
    assert entries(kernels.tensor3_innerprod(t, t))[()] == (x * x).sum()
    assert (dense(evaluate("X(i,j) = T(i,k,l) * C(j,k) * D(j,l)", {"T": t, "C": c, "D": d}), (5, 4)) == np.einsum("ikl,jk,jl->ij", x, y, z)).all()


def test_evaluate_broadcast_scalars_and_errors(spark):
    b = from_rows(spark, [(0, 2), (1, 3)], ["i"], (2,))
    m = from_rows(spark, [(0, 0, 1)], ["i", "j"], (2, 3))
    got = entries(evaluate("X(i,j) = b(i) - 4 * M(i,j)", {"b": b, "M": m}))
    assert got == {(0, 0): -2, (0, 1): 2, (0, 2): 2, (1, 0): 3, (1, 1): 3, (1, 2): 3}
    assert entries(evaluate("x = b(i) * b(i)", {"b": b})) == {(): 13}
    for bad in ("x(i) = b(i) / b(i)", "x(i) = q(i)", "x(i) = b(i"):
        with pytest.raises(ValueError):
            evaluate(bad, {"b": b})


@pytest.mark.parametrize("parts", [1, 7])
def test_positions_and_formats(spark, parts):
    t = generate.random_tensor(spark, ("i", "j", "k"), (4, 5, 6), 0.7, 9)
    pos = sorted((r["pos"], r["i"], r["j"], r["k"]) for r in formats.with_position(t.rows, ["i", "j", "k"], partitions=parts).collect())
    assert [p[0] for p in pos] == list(range(len(pos))) and [p[1:] for p in pos] == sorted(p[1:] for p in pos)
    crd, seg, vals = formats.to_csf(t)
    assert entries(formats.from_csf(crd, seg, vals, t.modes)) == entries(t)
    assert all(r["bad_start"] + r["not_monotone"] + r["bad_end"] + r["unsorted"] == 0 for r in check.check_csf(crd, seg).collect())


def test_csr_keeps_empty_rows(spark):
    t = from_rows(spark, [(1, 0, 5), (3, 2, 6)], ["i", "j"], (5, 3))
    ptr, _ = formats.to_csr(t)
    assert [r["ptr"] for r in ptr.orderBy("row").collect()] == [0, 0, 1, 1, 2, 2]
    assert entries(formats.from_csr(*formats.to_csr(t), ("i", "j"))) == entries(t)
    assert formats.to_dense(t).count() == 15
    with pytest.raises(ValueError):
        formats.to_dense(t, cells=10)


def test_tiles(spark):
    t = generate.random_tensor(spark, ("i", "j"), (20, 30), 0.8, 2)
    f = {"i": 6, "j": 7}
    assert entries(tiling.untile(tiling.tile(t, f), ["i", "j"], f)) == entries(t)
    s = tiling.tile_stats(t, 7, 6)
    assert s.count() == 3 * 5 and s.agg({"nnz": "sum"}).first()[0] == len(entries(t))
    assert tiling.tile_fit(tiling.tile_sizes(tiling.tile(t, f), ["i0", "j0"], "i"), 0).filter("fits").count() == 0


def test_compare_finds_differences(spark):
    a = from_rows(spark, [(0, 1), (1, 0), (2, 3)], ["i"])
    assert check.compare(a, from_rows(spark, [(0, 1), (2, 3)], ["i"])).first()["equal"]
    assert not check.compare(a, from_rows(spark, [(0, 1), (3, 3)], ["i"])).first()["equal"]
    assert not check.compare(a, from_rows(spark, [(0, 1), (2, 4)], ["i"])).first()["equal"]
    none = from_rows(spark, [], ["i"])
    assert check.compare(none, none).first()["equal"]


def test_generators(spark):
    m = generate.fixed_nnz_matrix(spark, 50, 40, 1)
    assert m.df.count() == m.df.select("i", "j").distinct().count() == 50
    one, two = generate.runs_vectors(spark, 5, 30)
    a, b = ({r["i"] for r in v.df.collect()} for v in (one, two))
    assert len(a) == len(b) == 30 and a & b and a - b and b - a
    one, two = generate.block_vectors(spark, 40, 8, 400, 3)
    assert one.df.count() == two.df.count() == 40
    assert entries(generate.other_vector(spark, "i", 50, 0.5, 1)).keys() == entries(generate.other_vector(spark, "i", 50, 0.5, 1)).keys()


def test_sddmm_pairs_by_coordinate(spark):
    b = from_rows(spark, [(0, 0, 2), (1, 0, 1)], ["i", "j"], (2, 1))
    c = from_rows(spark, [(0, 0, 3), (0, 2, 4), (1, 1, 5), (1, 2, 6)], ["i", "k"], (2, 3))
    d = from_rows(spark, [(0, 0, 1), (1, 0, 10), (2, 0, 100)], ["k", "j"], (3, 1))
    assert {tuple(r) for r in kernels.mat_sddmm(b, c, d).rows.collect()} == {(0, 0, 2 * 403), (1, 0, 650)}


def test_diagonals_and_early_sums(spark):
    b = from_rows(spark, [(0, 0, 3), (0, 1, 4), (1, 1, 5)], ["i", "k"], (2, 2))
    c = from_rows(spark, [(0, 0, 1), (1, 0, 2), (1, 1, 7)], ["k", "j"], (2, 2))
    assert evaluate("x = B(i,i)", {"B": b}).rows.collect()[0][0] == 8
    gold = {(i, m): v for i, m, v in [(0, 0, 3 * 1 * 1 + 4 * 2 * 1 + 4 * 7 * 2), (0, 1, 4 * 7 * 7), (1, 0, 5 * 2 * 1 + 5 * 7 * 2), (1, 1, 5 * 7 * 7)]}
    got = evaluate("X(i,m) = B(i,k) * C(k,j) * C(j,m)", {"B": b, "C": c})
    assert {(r["i"], r["m"]): r["val"] for r in got.rows.collect()} == gold


def test_companions_of_every_job(spark):
    t = from_rows(spark, [(0, 0, 3), (1, 2, 4)], ["i", "j"], (20, 30))
    assert tiling.other_tensors("mat_sddmm", t) == tiling.other_tensors("mat_vecmul", t) == tiling.other_tensors("mat_residual", t) == {}
    (other,) = tiling.other_tensors("something_else", t).values()
    assert other.shape == (20, 30) and other.modes == ("i", "j")


def test_hot_coordinate_is_spread(spark):
    """Half of the products in one k: no task has more than three times the median."""
    r = np.random.default_rng(5)
    b = [(i, 0, 1) for i in range(300)] + [(int(i), int(k), 1) for i, k in {*zip(r.integers(0, 300, 3000), r.integers(1, 100, 3000))}]
    c = [(0, j, 1) for j in range(300)] + [(int(k), int(j), 1) for k, j in {*zip(r.integers(1, 100, 3000), r.integers(0, 300, 3000))}]
    b, c = from_rows(spark, b, ["i", "k"], (300, 100)), from_rows(spark, c, ["k", "j"], (100, 300))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for flow in ("outer", "rows", "columns"):
            n = sorted(x["count"] for x in kernels.products(b, c, flow).groupBy(F.spark_partition_id()).count().collect())
            assert len(n) == 8 and n[-1] <= 3 * n[4], (flow, n)
        heavy = kernels.heavy_coordinates(b, c, 8).collect()
        assert 1 <= len(heavy) <= 32 and max((h["_rows"] * h["_columns"], h["k"]) for h in heavy)[1] == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_tiles_as_rows(spark, kind):
    """Full tiles go as dense blocks, others by matching entries; partials are those of every pair of tiles."""
    r = np.random.default_rng(6)
    x, y = r.integers(-3, 4, (40, 33)), r.integers(-3, 4, (33, 25))
    x[:8, :8], y[:8, :8] = 2, 3
    x[20:], y[:, 16:] = x[20:] * (r.random((20, 33)) < 0.1), y[:, 16:] * (r.random((33, 9)) < 0.1)
    rows = lambda m: [(int(a), int(b), float(m[a, b]) if kind == "double" else int(m[a, b])) for a, b in zip(*np.nonzero(m))]
    b, c = from_rows(spark, rows(x), ["i", "k"], x.shape, kind), from_rows(spark, rows(y), ["k", "j"], y.shape, kind)
    whole = kernels.matmul_tiled(b, c, (2, 4))
    assert (dense(whole, (40, 25)) == x @ y).all() and dict(whole.df.dtypes)["val"] == {"long": "bigint"}.get(kind, kind)
    parts = kernels.matmul_tile_partials(b, c, (2, 4)).df.collect()
    assert len({tuple(p)[:-1] for p in parts}) == len(parts)
    gold = {}
    for i, k in zip(*np.nonzero(x)):
        for j in np.nonzero(y[k])[0]:
            key = (i // 8, k // 8, j // 8, i % 8 // 4, k % 8 // 4, j % 8 // 4, i % 4, j % 4)
            gold[key] = gold.get(key, 0) + x[i, k] * y[k, j]
    assert {(p["i00"], p["k00"], p["j00"], p["i0"], p["k0"], p["j0"], p["i"], p["j"]): p["val"] for p in parts} == gold
    big = from_rows(spark, [(0, k, 1 << 40) for k in range(4)] + [(1, k, 1) for k in range(4)], ["i", "k"])
    one = from_rows(spark, [(k, j, (1 << 20) + 1) for k in range(4) for j in range(4)], ["k", "j"])
    assert entries(kernels.matmul_tiled(big, one, (1, 4)))[0, 0] == 4 * (1 << 40) * ((1 << 20) + 1)
    none = from_rows(spark, [], ["k", "j"])
    assert kernels.matmul_tiled(big, none, (1, 4)).df.count() == 0


def test_task_sums_go_on_when_full(spark, monkeypatch):
    from loomgrid.plans import blocks

    b = generate.random_tensor(spark, ("i", "k"), (40, 30), 0.5, 1)
    c = generate.random_tensor(spark, ("k", "j"), (30, 50), 0.5, 2)
    gold = dense(b) @ dense(c)
    monkeypatch.setattr(blocks, "PRODUCTS", 16)
    for held in (8, 600, 5000):
        monkeypatch.setattr(blocks, "HELD", held)
        assert (dense(kernels.matmul_tiled(b, c, (2, 8)), (40, 50)) == gold).all()


def test_long_rows_in_segments(spark):
    """Rows of a dense factor are cut in slots; a gap in one factor stays a gap."""
    b = from_rows(spark, [(0, 0, 2), (1, 1, 1), (0, 1, 5)], ["i", "j"], (2, 2))
    c = from_rows(spark, [(0, k, k + 1) for k in range(200)] + [(1, 7, 3), (1, 150, 4)], ["i", "k"], (2, 200))
    d = from_rows(spark, [(k, 0, 1) for k in range(200)] + [(150, 1, 10)], ["k", "j"], (200, 2))
    assert {tuple(r) for r in kernels.mat_sddmm(b, c, d).rows.collect()} == {(0, 0, 2 * 20100), (1, 1, 40), (0, 1, 5 * 1510)}
    widest = kernels.in_slots(c, ["i"], "k").select(F.max(F.size("_v"))).first()[0]
    assert widest == kernels.WIDTH


@pytest.mark.parametrize("width", [2, 64])
def test_factors_as_arrays(spark, width):
    t = generate.random_tensor(spark, ("i", "k", "l"), (5, 6, 7), 0.6, 3)
    c = generate.random_tensor(spark, ("j", "k"), (5, 6), 0.4, 4)
    d = generate.random_tensor(spark, ("j", "l"), (5, 7), 0.4, 5)
    x, y, z = dense(t), dense(c), dense(d)
    assert (dense(kernels.tensor3_mttkrp(t, c, d, width), (5, 5)) == np.einsum("ikl,jk,jl->ij", x, y, z)).all()
    assert (dense(kernels.tensor3_ttm(t, d, width), (5, 6, 5)) == np.einsum("ikl,jl->ikj", x, z)).all()


def shares(tree, variables):
    """Whether every join of a plan has a shared variable."""
    from loomgrid.plans.expression import leaves

    if not isinstance(tree, tuple):
        return True
    a, b = ({v for k in leaves(x) for v in variables[k]} for x in tree)
    return bool(a & b) and all(shares(x, variables) for x in tree)


def test_order_of_contraction(spark):
    from loomgrid.plans.expression import Part, contraction_order, leaves

    even = lambda **v: Part({k: float(n) for k, n in v.items()}, float(max(v.values()) * 10))
    parts = [even(i=100, k=100), even(l=100, m=100), even(k=100, l=100)]
    tree = contraction_order(parts, {"i", "m"})
    assert shares(tree, [p.counts for p in parts]) and sorted(leaves(tree)) == [0, 1, 2]
    # a chain starts at its small end
    chain = [Part({"i": 10.0, "k": 10.0}, 20.0), Part({"k": 1e4, "l": 1e4}, 1e6), Part({"l": 1e4, "m": 1e4}, 1e6)]
    assert contraction_order(chain, {"i", "m"}) == ((0, 1), 2)
    assert contraction_order(chain, {"i", "m"}, {(0, 1): 1e12}) == (0, (1, 2))
    long_chain = [even(**{f"v{k}": 50, f"v{k + 1}": 50}) for k in range(12)]
    tree = contraction_order(long_chain, {"v0", "v12"})
    assert shares(tree, [p.counts for p in long_chain]) and sorted(leaves(tree)) == [*range(12)]
    apart = [even(i=5), even(j=5), even(i=5, k=5)]
    assert contraction_order(apart, {"i", "j"}) in (((0, 2), 1), (1, (0, 2)))


def test_planned_products_and_formats(spark):
    t = {n: generate.random_tensor(spark, modes, (6, 6), 0.5, k) for k, (n, modes) in enumerate({"A": ("i", "k"), "B": ("l", "m"), "C": ("k", "l")}.items())}
    x = {n: dense(v) for n, v in t.items()}
    got = evaluate("X(i,m) = A(i,k) * B(l,m) * C(k,l)", t, fmt="ss10")
    assert (dense(got, (6, 6)) == np.einsum("ik,lm,kl->im", *x.values())).all()
    rows = [(r["m"], r["i"]) for r in got.rows.collect()]
    assert rows == sorted(rows)
    outer = evaluate("X(i,m) = A(i,k) * B(l,m)", t)
    assert (dense(outer, (6, 6)) == np.einsum("ik,lm->im", x["A"], x["B"])).all()
    m = from_rows(spark, [(0, 1, 5), (3, 0, 6)], ["i", "j"], (4, 3))
    same = lambda fmt: [tuple(r) for r in evaluate("X(i,j) = M(i,j)", {"M": m}, fmt).rows.collect()]
    assert same("sd") == [(0, 0, 0), (0, 1, 5), (0, 2, 0), (3, 0, 6), (3, 1, 0), (3, 2, 0)]
    assert same("ds01") == [(0, 1, 5), (3, 0, 6)] and len(same("dd10")) == 12 and same("dd10")[1] == (1, 0, 0)
    for bad in ("s", "sx01", "ss00"):
        with pytest.raises(ValueError):
            same(bad)


def test_pairs_have_a_guard(spark, monkeypatch):
    from loomgrid.operators import joins

    monkeypatch.setattr(joins, "PAIRS", 10)
    a, b = from_rows(spark, [(k, 1) for k in range(5)], ["i"], (5,)), from_rows(spark, [(k, 1) for k in range(3)], ["j"], (3,))
    with pytest.raises(ValueError):
        kernels.product(a, b)
    with pytest.raises(ValueError):
        joins.repeat(a, b.df.select("j"))
    with pytest.raises(ValueError):
        generate.dense_ones(spark, ("i", "j"), (4, 4), cells=15)


def test_cost_of_outputs(spark):
    b = generate.random_tensor(spark, ("i", "k"), (20, 30), 0.8, 1)
    c = generate.random_tensor(spark, ("k", "j"), (30, 5000), 0.8, 2)
    x, y = (dense(b) != 0).astype(int), (dense(c) != 0).astype(int)
    counts = {(r["i"], r["j"]): r["products"] for r in kernels.output_cost(b, c).collect()}
    p = x @ y
    assert counts == {(int(i), int(j)): int(p[i, j]) for i, j in zip(*np.nonzero(p))}
    gold = (p > 0).sum(axis=1)
    exact = {r["i"]: r["entries"] for r in stats.product_rows(b, c, 14).collect()}
    rough = {r["i"]: r["entries"] for r in stats.product_rows(b, c, 10).collect()}
    assert exact == {int(i): int(n) for i, n in enumerate(gold) if n}
    assert all(abs(rough[i] - gold[i]) <= 0.15 * gold[i] for i in rough) and rough.keys() == exact.keys()


@pytest.mark.parametrize("order", [None, (2, 0, 1)])
def test_levels_share_one_sort(spark, order):
    """Nodes that go on across partitions are one node; more partitions than nodes leave some empty."""
    r = np.random.default_rng(7)
    rows = [(0, 0, int(k), 1) for k in range(300)] + [(int(a), int(b), int(c), 1) for a, b, c in {*zip(r.integers(0, 4, 300), r.integers(0, 5, 300), r.integers(300, 320, 300))}]
    t = from_rows(spark, rows, ["i", "j", "k"], (4, 5, 320))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        crd, seg, vals = formats.to_csf(t, order)
        modes = [t.modes[k] for k in order or (0, 1, 2)]
        got = {(x["level"], x["pos"]): (x["fiber"], x["crd"]) for x in crd.collect()}
        gold, parent = {}, {(): 0}
        for level in range(3):
            prefixes = sorted({tuple(x[t.modes.index(m)] for m in modes[: level + 1]) for x in rows})
            gold |= {(level, p): (parent[x[:-1]], x[-1]) for p, x in enumerate(prefixes)}
            parent = {x: p for p, x in enumerate(prefixes)}
        assert got == gold and vals.count() == len(rows)
        assert all(c["bad_start"] + c["not_monotone"] + c["bad_end"] + c["unsorted"] == 0 for c in check.check_csf(crd, seg).collect())
        back = formats.from_csf(crd, seg, vals, modes)
        assert {tuple(x[m] for m in t.modes) for x in back.rows.collect()} == {x[:3] for x in rows}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_deleted_runs(spark):
    r = np.random.default_rng(8)
    at = sorted({int(x) for x in r.integers(0, 5000, 2000)})
    v = from_rows(spark, [(x, x + 1) for x in at], ["i"], (5000,))
    runs = [(int(a), int(a + n)) for a, n in zip(r.integers(0, 5000, 300), r.integers(0, 12, 300))] + [(4000, 4400), (4100, 4200), (10, 9), (at[0], at[0])]
    df = spark.createDataFrame(runs, "start long, end long")
    gold = {(x,): x + 1 for x in at if not any(a <= x <= b for a, b in runs)}
    got = stats.delete_run(v, df)
    assert entries(got) == gold and "NestedLoop" not in got.df._jdf.queryExecution().toString()
    assert entries(stats.delete_run(v, df.limit(0))) == {(x,): x + 1 for x in at}
    many = spark.range(200_000).selectExpr("id * 7 AS start", "id * 7 + 2 AS end")
    wide = Tensor(spark.range(0, 1_400_000, 5).selectExpr("id AS i", "1L AS val"), ("i",), (1_400_000,))
    assert stats.delete_run(wide, many).df.count() == sum(1 for x in range(0, 1_400_000, 5) if x % 7 > 2)


def test_long_fibers_of_words(spark):
    """References by blocks, with fibers longer than one."""
    from loomgrid.operators import bits

    t = generate.random_tensor(spark, ("i", "j"), (3, 400), 0.5, 4)
    words = bits.to_bitvector(t, 5)
    small = formats.running_sum(words, "word_id", F.bit_count("word"), "ref", block=7, fiber=["i"])
    assert {tuple(r) for r in small.select("i", "word_id", "ref").collect()} == {tuple(r) for r in bits.bit_refs(words, ["i"]).select("i", "word_id", "ref").collect()}
    gold, seen = {}, {}
    for i, j in sorted(entries(t)):
        gold.setdefault((i, j // 5), seen.get(i, 0))
        seen[i] = seen.get(i, 0) + 1
    assert {(r["i"], r["word_id"]): r["ref"] for r in small.collect()} == gold
    stored = sorted(entries(t))
    assert {(r["i"], r["j"]): r["ref"] for r in bits.with_refs(t).collect()} == {k: n for i in range(3) for n, k in enumerate(x for x in stored if x[0] == i)}


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_bit_trees_of_many_levels(spark, levels):
    from loomgrid.operators import bits

    a, b = (generate.random_tensor(spark, ("i", "j"), (3, 700), 0.6, k) for k in (5, 6))
    x, y = entries(a), entries(b)
    gold = {k: v * y[k] for k, v in x.items() if k in y}
    assert entries(bits.elemmul_bittree(a, b, 4, levels)) == gold


def test_drawn_cells_follow_one_law(spark):
    """Entries are binomial at every size, gaps geometric, and the cost is by entries."""
    t = generate.random_tensor(spark, ("i", "j"), (300, 400), 0.9, 3)
    got = entries(t)
    assert abs(len(got) - 12_000) < 6 * (120_000 * 0.09) ** 0.5 and got == entries(generate.random_tensor(spark, ("i", "j"), (300, 400), 0.9, 3))
    assert all(0 <= i < 300 and 0 <= j < 400 and 1 <= v < 255 for (i, j), v in got.items())
    cells = np.array(sorted(i * 400 + j for i, j in got))
    gaps = np.diff(cells)
    assert abs((gaps == 1).mean() - 0.1) < 0.02 and abs(gaps.mean() - 10) < 0.5
    huge = generate.random_tensor(spark, ("i", "j"), (1 << 30, 1 << 20), 1 - 2.0**-36, 3)
    assert abs(huge.df.count() - (1 << 14)) < 6 * 128 and huge.df.select("i", "j").distinct().count() == huge.df.count()
    assert generate.random_tensor(spark, ("i",), (50,), 0.0, 1).df.count() == 50 and generate.random_tensor(spark, ("i",), (50,), 1.0, 1).df.count() == 0


def test_fibers_in_segments(spark):
    t = generate.random_tensor(spark, ("i", "j"), (4, 500), 0.5, 2)
    f = formats.to_fibers(t, ["i"], 50).collect()
    assert max(len(r["fiber"]) for r in f) <= 50
    whole = {}
    for r in sorted(f, key=lambda r: r["segment"]):
        whole.setdefault(r["i"], []).extend((e["crd"], e["val"]) for e in r["fiber"])
    stored = entries(t)
    assert whole == {i: sorted((j, v) for (k, j), v in stored.items() if k == i) for i in range(4)}
