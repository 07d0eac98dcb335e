"""Tiles: coordinates cut into tile numbers and local coordinates, at one or several levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.memory import MemoryConfig
from ..tensor import VAL, Tensor
from . import elementwise, formats, generate


def tile(t: Tensor, factors: Mapping[str, int], suffix: str = "0") -> Tensor:
    """Per mode m: column m + suffix = crd div factor, m = crd mod factor. Narrow."""
    ids = tuple(f"{m}{suffix}" for m in t.modes)
    cut = [F.floor(F.col(m) / factors[m]).cast("long").alias(i) for m, i in zip(t.modes, ids, strict=True)]
    local = [F.pmod(m, F.lit(factors[m])).alias(m) for m in t.modes]
    others = [c for c in t.df.columns if c not in (*t.modes, VAL)]
    shape = None if t.shape is None else (*[-(-n // factors[m]) for m, n in zip(t.modes, t.shape, strict=True)], *[factors[m] for m in t.modes])
    df = t.df.select(*others, *cut, *local, VAL)
    return Tensor(df, (*ids, *t.modes), shape)


def cotile(tensors: Sequence[Tensor], factors: Mapping[str, int], suffix: str = "0") -> list[Tensor]:
    """Several tensors, cut by the same factor in each index variable they share."""
    return [tile(t, factors, suffix) for t in tensors]


def cotile_multilevel(tensors: Sequence[Tensor], levels: Sequence[int | Mapping[str, int]]) -> list[Tensor]:
    """Tile numbers of several levels, coarsest first: for (16, 128) a coarse tile has 16 * 128, a fine one 128 coordinates.

    A level's size is one number, or one for each index variable. Its factor is the product of the sizes from it down;
    the numbers of level k end in as many zeros as there are levels from k down (i00, then i0).
    """
    size = lambda level, m: level if isinstance(level, int) else level[m]
    out = []
    for t in tensors:
        columns: list[F.Column] = []
        names: list[str] = []
        rest = {m: F.col(m) for m in t.modes}
        for k in range(len(levels)):
            for m in t.modes:
                factor = prod(size(level, m) for level in levels[k:])
                names.append(m + "0" * (len(levels) - k))
                columns.append(F.floor(rest[m] / factor).cast("long").alias(names[-1]))
                rest[m] = F.pmod(rest[m], F.lit(factor))
        df = t.df.select(*columns, *[rest[m].alias(m) for m in t.modes], VAL)
        out.append(Tensor(df, (*names, *t.modes)))
    return out


def cotile_config(tensors: Sequence[Tensor], config: MemoryConfig) -> list[Tensor]:
    """Tiles with the sizes that a memory configuration gives."""
    return cotile_multilevel(tensors, config.tile_sizes)


def cotile_fitted(tensors: Sequence[Tensor], config: MemoryConfig) -> tuple[list[Tensor], list[dict[str, int]]]:
    """Tiles with the largest factors that the memories of a configuration hold, and each level's factors, coarsest first."""
    if missing := [x.name for x in config.levels if x.memory is None]:
        raise ValueError(f"no memory for {', '.join(missing)}")
    factors = fit_factors(tensors, [x.memory for x in config.levels], config.element_bytes)
    sizes = [{m: n // below.get(m, 1) for m, n in at.items()} for at, below in zip(factors, [*factors[1:], {}], strict=True)]
    return cotile_multilevel(tensors, sizes), factors


def tile_pyramid(t: Tensor, candidates: Sequence[Mapping[str, int]]) -> DataFrame:
    """For each candidate (the power of two of every variable's factor): its number, tiles, and the size of the largest tile.

    All candidates are counted in one pass: an entry gives a row for each, combined before it is shuffled by tile and
    first coordinate, then by tile. No tile's entries meet in one task.
    """
    first, names = t.modes[0], [f"{m}0" for m in t.modes]
    by = F.array(*[F.struct(F.lit(k).alias("candidate"), *[F.lit(2 ** c[m]).cast("long").alias(m) for m in t.modes]) for k, c in enumerate(candidates)])
    entries = t.df.select(*t.modes, F.explode(by).alias("_by"))
    ids = [F.floor(F.col(m) / F.col("_by")[m]).cast("long").alias(n) for m, n in zip(t.modes, names, strict=True)]
    rows = entries.select(F.col("_by.candidate").alias("_c"), *ids, F.col(first).alias("_row")).groupBy("_c", *names, "_row").agg(F.count(F.lit(1)).alias("_n"))
    tiles = rows.groupBy("_c", *names).agg((2 * F.sum("_n") + 2 * F.count(F.lit(1)) + 3).alias("_size"))
    return tiles.groupBy(F.col("_c").alias("candidate")).agg(F.count(F.lit(1)).alias("tiles"), F.max("_size").alias("largest"))


def _largest(tensors: Sequence[Tensor], candidates: Sequence[Mapping[str, int]]) -> list[int]:
    """Stored numbers of the largest tiles of all tensors together, for each candidate."""
    total = [0] * len(candidates)
    for t in tensors:
        for r in tile_pyramid(t, candidates).collect():  # a row per candidate
            total[r["candidate"]] += r["largest"]
    return total


def fit_factors(tensors: Sequence[Tensor], budgets: Sequence[int], element_bytes: int = 2) -> list[dict[str, int]]:
    """For each budget of bytes, the largest powers of two per index variable such that the largest tiles of all tensors fit in it together.

    First the greatest factor that all variables can have, then, from there, the one variable that can grow most
    (ties: the first). A variable's factor ends where one tile has all its coordinates. A tile of a larger budget has
    whole tiles of a smaller one. An error where not even single coordinates fit.
    """
    modes = list(dict.fromkeys(m for t in tensors for m in t.modes))
    most = {m: max(max(t.dim(m) - 1, 0).bit_length() for t in tensors if m in t.modes) for m in modes}
    even = [{m: min(e, most[m]) for m in modes} for e in range(max(most.values()) + 1)]
    sizes = _largest(tensors, even)
    fits = [[n * element_bytes <= budget for n in sizes] for budget in budgets]
    if bad := [b for b, f in zip(budgets, fits, strict=True) if not f[0]]:
        raise ValueError(f"no tile fits in {bad} bytes")
    base = [even[max(e for e, ok in enumerate(f) if ok)] for f in fits]
    # a larger tile is at least as full, so what fits at e fits below e
    grown = [(k, m, {**c, m: e}) for k, c in enumerate(base) for m in modes for e in range(c[m] + 1, most[m] + 1)]
    best = list(base)
    for (k, _, c), n in zip(grown, _largest(tensors, [c for *_, c in grown]) if grown else [], strict=True):
        if n * element_bytes <= budgets[k] and sum(c.values()) > sum(best[k].values()):
            best[k] = c
    # levels nest: a greater budget's factors aren't below a smaller one's
    order = sorted(range(len(budgets)), key=lambda k: budgets[k])
    for a, b in zip(order, order[1:]):
        if any(best[b][m] < best[a][m] for m in modes):
            best[b] = base[b] if all(base[b][m] >= best[a][m] for m in modes) else best[a]
    return [{m: 2 ** c[m] for m in modes} for c in best]


def tile_sizes(tiles: Tensor, ids: Sequence[str], row: str) -> DataFrame:
    """Stored size of each tile: two numbers per entry, two per row that isn't empty, and 3."""
    return tiles.df.groupBy(*ids).agg((2 * F.count(F.lit(1)) + 2 * F.count_distinct(row) + 3).alias("size"))


def tile_coordinates(tiles: Tensor, ids: Sequence[str], keep_empty: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compressed fibers of the grid of tiles that exist, or of the whole grid, however large: its positions are counted, not sorted."""
    if keep_empty:
        return formats.full_csf(tiles.df.sparkSession, [tiles.dim(i) for i in ids])
    return formats.to_csf(Tensor(tiles.df.select(*ids).distinct().withColumn(VAL, F.lit(1)), tuple(ids)))


def untile(tiles: Tensor, modes: Sequence[str], factors: Mapping[str, int], suffix: str = "0", shape: Sequence[int] | None = None) -> Tensor:
    """Global coordinates again: tile number * factor + local."""
    columns = [(F.col(f"{m}{suffix}") * factors[m] + F.col(m)).alias(m) for m in modes]
    return Tensor(tiles.df.select(*columns, VAL), tuple(modes), None if shape is None else tuple(shape))


def tile_stats(t: Tensor, width: int, height: int, full_grid: bool = True) -> DataFrame:
    """Per tile of ``width`` rows and ``height`` columns: entries, dimensions (cut at the edge), density, segment and coordinate array sizes."""
    i, j = t.modes
    di, dj = t.shape
    cut = tile(t, {i: width, j: height})
    got = cut.df.groupBy(f"{i}0", f"{j}0").agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct(i).alias("rows"))
    if full_grid:
        if -(-di // width) * -(-dj // height) > formats.DENSE_CELLS:
            raise ValueError("the grid has too many tiles; leave the empty ones out")
        grid = t.df.sparkSession.range(-(-di // width)).withColumnRenamed("id", f"{i}0").crossJoin(t.df.sparkSession.range(-(-dj // height)).withColumnRenamed("id", f"{j}0"))
        got = grid.join(got, [f"{i}0", f"{j}0"], "left").fillna(0, ["nnz", "rows"])
    rows = F.least(F.lit(width), F.lit(di) - F.col(f"{i}0") * width).cast("long")
    columns = F.least(F.lit(height), F.lit(dj) - F.col(f"{j}0") * height).cast("long")
    return got.select(f"{i}0", f"{j}0", "nnz", rows.alias("dim1"), columns.alias("dim2"), (F.col("nnz") / (rows * columns)).alias("density"), (F.col("rows") + 3).alias("seg_size"), (F.col("rows") + F.col("nnz")).alias("crd_size"))


def other_tensors(app: str, t: Tensor, seed: int = 0) -> dict[str, Tensor]:
    """The companions that a job's tensor is run with: shifted, shifted and transposed, shifted twice, none, or a random one for other jobs."""
    shifted = elementwise.shift_last_mode(t)
    flipped = lambda: elementwise.permute_modes(shifted, (1, 0))
    kinds = {
        "matmul": lambda: {"C": flipped().rename("k", "j")},
        "mat_elemadd": lambda: {"C": shifted}, "mat_elemmul": lambda: {"C": shifted},
        "mat_sddmm": dict, "mat_mattransmul": dict, "mat_residual": dict, "mat_vecmul": dict,
        "mat_elemadd3": lambda: {"C": shifted, "D": elementwise.shift_last_mode(shifted)},
    }
    if app not in kinds:
        return {"C": generate.random_tensor(t.df.sparkSession, t.modes, t.shape, 0.99, seed)}
    return kinds[app]()


def tile_fit(sizes: DataFrame, budget_bytes: int, element_bytes: int = 2) -> DataFrame:
    """Which tiles fit in a memory of the given size."""
    return sizes.withColumn("fits", F.col("size") * element_bytes <= budget_bytes)


def tile_pair_join(b: Tensor, c: Tensor, keys: Sequence[str]) -> DataFrame:
    """Pairs of tiles that agree in the contracted tile numbers; where one side is absent there is no pair."""
    bt = b.df.select(*[m for m in b.modes if m.endswith("0")]).distinct()
    ct = c.df.select(*[m for m in c.modes if m.endswith("0")]).distinct()
    return bt.join(ct, list(keys))
