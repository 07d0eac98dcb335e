"""Memory configurations and the factors that fit, against counts with plain loops."""

import random
from collections import defaultdict
from itertools import product

import pytest

from loomgrid.operators import formats, generate, tiling
from loomgrid.sources import memory
from loomgrid.tensor import from_rows

CONFIG = """clk: 1000000000 # Hz
main_memory: "None" # no bound
Glb_memory: 17100000 # Bytes
Mem_memory: 70000 # Bytes
Bytes_per_element: 2 # Number

n_levels: 3
level_names: ["Main", "Glb", "Mem"]
Main_tile_size: None
Glb_tile_size: 16 # 120
Mem_tile_size: 128 # 8 = (8x8)
"""


def write(spark, tmp_path, text):
    at = tmp_path / "memory.yaml"
    at.write_text(text)
    return memory.read_memory_config(spark, str(at))


def largest(rows, modes, shifts):
    """Size of the largest tile, entry by entry."""
    n, first = defaultdict(int), defaultdict(set)
    for r in rows:
        tile = tuple(c >> shifts[m] for c, m in zip(r, modes, strict=True))
        n[tile] += 1
        first[tile].add(r[0])
    return max((2 * n[t] + 2 * len(first[t]) + 3 for t in n), default=0)


def some(dims, n, seed):
    """Entries of which a third lie in one row."""
    r = random.Random(seed)
    got = {tuple(r.randrange(d) for d in dims) for _ in range(n)}
    return sorted(got | {(3, *[r.randrange(d) for d in dims[1:]]) for _ in range(n // 2)})


def test_configuration_file(spark, tmp_path):
    config = write(spark, tmp_path, CONFIG)
    assert config.levels == (memory.Level("Glb", 16, 17_100_000), memory.Level("Mem", 128, 70_000)) and config.element_bytes == 2
    assert config.tile_sizes == (16, 128)
    t = from_rows(spark, [(0, 5000, 1), (2047, 2048, 2), (4100, 127, 3)], ["i", "k"], (5000, 6000))
    # coarse tiles of 16 * 128 coordinates, fine ones of 128
    assert sorted(tuple(r) for r in tiling.cotile_config([t], config)[0].rows.collect()) == sorted([(0, 2, 0, 7, 0, 8, 1), (0, 1, 15, 0, 127, 0, 2), (2, 0, 0, 0, 4, 127, 3)])


def test_configurations_that_say_too_little(spark, tmp_path):
    with pytest.raises(ValueError, match="level_names"):
        write(spark, tmp_path, "Glb_tile_size: 3\n")
    with pytest.raises(ValueError, match="n_levels"):
        write(spark, tmp_path, 'n_levels: 2\nlevel_names: ["Main", "Glb", "Mem"]\n')
    with pytest.raises(ValueError, match="positive"):
        write(spark, tmp_path, 'level_names: ["Main", "Mem"]\nMem_tile_size: 0\n')
    bare = write(spark, tmp_path, 'level_names: ["Main", "Mem"]\n')
    t = from_rows(spark, [(0, 1)], ["i"], (4,))
    with pytest.raises(ValueError, match="no tile size for Mem"):
        tiling.cotile_config([t], bare)
    with pytest.raises(ValueError, match="no memory for Mem"):
        tiling.cotile_fitted([t], bare)
    with pytest.raises(ValueError, match="no tile fits"):
        tiling.fit_factors([t], [13])


def test_sizes_of_each_variable(spark):
    t = from_rows(spark, [(13, 50, 1)], ["i", "k"], (16, 64))
    assert tuple(tiling.cotile_multilevel([t], [{"i": 2, "k": 4}, {"i": 4, "k": 8}])[0].rows.first()) == (1, 1, 1, 2, 1, 2, 1)


def test_pyramid_against_loops(spark):
    rows, modes = some((40, 300, 7), 500, 1), ("i", "j", "k")
    t = from_rows(spark, [(*r, 1) for r in rows], modes, (40, 300, 7))
    candidates = [dict(zip(modes, c, strict=True)) for c in product((0, 2, 6), (0, 3, 9), (0, 3))]
    got = {r["candidate"]: (r["tiles"], r["largest"]) for r in tiling.tile_pyramid(t, candidates).collect()}
    assert got == {k: (len({tuple(x >> c[m] for x, m in zip(r, modes, strict=True)) for r in rows}), largest(rows, modes, c)) for k, c in enumerate(candidates)}


@pytest.mark.parametrize("budgets", [(4000, 300), (60, 4000), (100_000, 28)])
def test_factors_are_the_largest_that_fit(spark, budgets):
    """B(i, k) and C(k, j) share k; with a hot row in each, no tile pair is over budget, and no single step further fits."""
    b, c = some((50, 700), 600, 2), some((700, 20), 400, 3)
    tensors = [from_rows(spark, [(*r, 1) for r in b], ["i", "k"], (50, 700)), from_rows(spark, [(*r, 1) for r in c], ["k", "j"], (700, 20))]
    total = lambda s: 2 * (largest(b, ("i", "k"), s) + largest(c, ("k", "j"), s))
    most = {"i": 6, "k": 10, "j": 5}
    got = tiling.fit_factors(tensors, budgets)
    for budget, factors in zip(budgets, got, strict=True):
        shifts = {m: n.bit_length() - 1 for m, n in factors.items()}
        assert total(shifts) <= budget
        even = max(e for e in range(11) if total({m: min(e, most[m]) for m in most}) <= budget)
        base = {m: min(even, most[m]) for m in most}
        grown = [{**base, m: e} for m in most for e in range(base[m], most[m] + 1)]
        assert sum(shifts.values()) == max(sum(s.values()) for s in grown if total(s) <= budget)
    small, great = sorted(zip(budgets, got, strict=True), key=lambda x: x[0])
    assert all(great[1][m] % small[1][m] == 0 for m in most)


def test_fitted_tiles_of_two_levels(spark, tmp_path):
    config = write(spark, tmp_path, 'level_names: ["Main", "Glb", "Mem"]\nGlb_memory: 3000\nMem_memory: 400\nBytes_per_element: 4\n')
    rows = some((60, 500), 700, 4)
    t = from_rows(spark, [(*r, 1) for r in rows], ["i", "k"], (60, 500))
    (tiles,), (coarse, fine) = tiling.cotile_fitted([t], config)
    for at, ids, budget in ((coarse, ["i00", "k00"], 3000), (fine, ["i00", "k00", "i0", "k0"], 400)):
        over = tiling.tile_fit(tiling.tile_sizes(tiles if at is fine else tiling.tile(t, at, "00"), ids, "i"), budget, 4)
        assert over.filter("NOT fits").count() == 0
    back = sorted((r["i00"] * coarse["i"] + r["i0"] * fine["i"] + r["i"], r["k00"] * coarse["k"] + r["k0"] * fine["k"] + r["k"]) for r in tiles.rows.collect())
    assert back == rows


def test_no_entries(spark):
    t = from_rows(spark, [], ["i", "k"], (8, 5))
    assert tiling.fit_factors([t], [10]) == [{"i": 8, "k": 8}]


def test_whole_grid_of_any_size(spark):
    """The fibers of a whole grid are those of a tensor of ones; a grid beyond any dense form isn't refused."""
    ones = generate.dense_ones(spark, ("a", "b", "c"), (3, 4, 5))
    for made, sorted_ in zip(formats.full_csf(spark, (3, 4, 5)), formats.to_csf(ones), strict=True):
        assert dict(made.dtypes).keys() == dict(sorted_.dtypes).keys() and {tuple(r) for r in made.collect()} == {tuple(r) for r in sorted_.select(*made.columns).collect()}
    t = from_rows(spark, [(0, 0, 1)], ["i", "k"], (80_000, 160_000))
    crd = tiling.tile_coordinates(tiling.tile(t, {"i": 8, "k": 16}), ["i0", "k0"], keep_empty=True)[0]
    last = crd.filter("level = 1 AND pos >= 99999998").orderBy("pos").collect()
    assert [tuple(r) for r in last] == [(1, 99_999_998, 9_999, 9_998), (1, 99_999_999, 9_999, 9_999)]
