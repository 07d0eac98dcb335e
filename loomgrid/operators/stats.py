"""Statistics of tensors and collections of matrices, and tables of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tensor import VAL, Tensor
from .formats import running_sum, with_position


def corpus_stats(entries: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per matrix of a collection: name, nnz, dim1, dim2, density, seg_size, crd_size, in one pass.

    ``entries``: (tensor, i, j, val); ``shapes``: (tensor, dim1, dim2).
    """
    got = entries.groupBy("tensor").agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct("i").alias("rows"))
    both = shapes.join(got, "tensor", "left").fillna(0, ["nnz", "rows"])
    return both.select(F.col("tensor").alias("name"), "nnz", "dim1", "dim2", (F.col("nnz") / (F.col("dim1") * F.col("dim2"))).alias("density"), (F.col("rows") + 3).alias("seg_size"), (F.col("rows") + F.col("nnz")).alias("crd_size"))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between least and greatest value: bin (from 0), low, high, n; empty bins included."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("long")
    counts = df.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(F.broadcast(ends)).filter("lo IS NOT NULL")
    step = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def _sides(a: Tensor, b: Tensor) -> DataFrame:
    """Coordinates of either tensor with a mark for each side: one aggregation, no join."""
    x = a.df.select(*a.modes, F.lit(1).alias("l"), F.lit(0).alias("r"))
    y = b.df.select(*a.modes, F.lit(0).alias("l"), F.lit(1).alias("r"))
    return x.unionByName(y).groupBy(*a.modes).agg(F.max("l").alias("l"), F.max("r").alias("r"))


def intersection_stats(a: Tensor, b: Tensor) -> DataFrame:
    """Matches, coordinates on one side only, and the share of matches."""
    n = _sides(a, b).agg(
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("matches"), F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only")
    )
    total = F.col("matches") + F.col("left_only") + F.col("right_only")
    return n.withColumn("rate", F.when(total > 0, F.col("matches") / total).otherwise(F.lit(0.0)))


def union_stats(a: Tensor, b: Tensor) -> DataFrame:
    """Coordinates of both, of one only, and all."""
    return intersection_stats(a, b).select(F.col("matches").alias("both_sides"), F.col("left_only").alias("one_only"), F.col("right_only").alias("two_only"), (F.col("matches") + F.col("left_only") + F.col("right_only")).alias("total"))


def repeat_stats(t: Tensor, outer: Sequence[str]) -> DataFrame:
    """How often outer coordinates are repeated: in all and at most."""
    n = t.df.groupBy(*outer).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.max("n").alias("most"))


def stream_breakdown(t: Tensor) -> DataFrame:
    """Per level: coordinates, fiber ends and their shares, the costly levels first."""
    levels = []
    for k in range(t.order):
        fibers = F.lit(1).cast("long") if k == 0 else F.count_distinct(*t.modes[:k])
        levels.append(t.df.agg(F.lit(k).cast("long").alias("level"), F.count_distinct(*t.modes[: k + 1]).alias("coords"), fibers.alias("fiber_ends")))
    out = reduce(DataFrame.union, levels)
    total = F.col("coords") + F.col("fiber_ends")
    return out.select("level", "coords", "fiber_ends", (F.col("coords") / total).alias("coord_share"), (F.col("fiber_ends") / total).alias("end_share")).orderBy(F.desc(F.col("coords") + F.col("fiber_ends")), "level")


def runs(a: Tensor, b: Tensor, dim: int | None = None) -> DataFrame:
    """Maximal runs in which only one of two vectors has entries: run, side (1 or 2), start, end, n.

    A run ends at its last entry; one that is open at the end ends at dim - 1. Entries are
    numbered by range partitions, neighbours meet by number, and runs are running sums of
    changes by blocks, so that one long vector isn't one task.
    """
    (m,) = a.modes
    dim = dim or a.dim(m)
    kind = _sides(a, b).select(m, F.when(F.col("l") == F.col("r"), 0).when(F.col("l") == 1, 1).otherwise(2).alias("side"))
    placed = with_position(kind, [m])
    before = placed.select((F.col("pos") + 1).alias("pos"), F.col("side").alias("prev"))
    marked = placed.join(before, "pos", "left").withColumn("new", F.coalesce((F.col("prev") != F.col("side")).cast("long"), F.lit(1)))
    numbered = running_sum(marked, "pos", "new", "upto").withColumn("run", F.col("upto") + F.col("new"))
    got = numbered.groupBy("run", "side").agg(F.min(m).alias("start"), F.max(m).alias("last"), F.count(F.lit(1)).alias("n"))
    top = numbered.agg(F.max("run").alias("top"))
    return got.filter("side <> 0").join(F.broadcast(top)).select("run", F.col("side").cast("long").alias("side"), "start", F.when(F.col("run") < F.col("top"), F.col("last")).otherwise(F.lit(dim - 1)).cast("long").alias("end"), "n")


def run_lengths(runs_: DataFrame) -> DataFrame:
    """Runs, entries in them and their mean length, per side."""
    return runs_.groupBy("side").agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("entries"), F.avg("n").alias("mean_length"))


def delete_run(v: Tensor, run: DataFrame) -> Tensor:
    """The vector without the entries of the given runs (start, end), however many, long or overlapping.

    A sweep: each run opens at its start and closes behind its end, and an entry stays where no run is open. Entries and ends are sorted by range
    together and the open runs are a running sum by blocks, so no entry is compared with a run.
    """
    (m,) = v.modes
    held = run.filter(F.col("start") <= F.col("end"))
    ends = held.select(F.col("start").alias(m), F.lit(1).cast("long").alias("_open")).union(held.select(F.col("end") + 1, F.lit(-1).cast("long")))
    kind = dict(v.df.dtypes)[VAL]
    marks = ends.groupBy(m).agg(F.sum("_open").alias("_open")).select(m, F.lit(None).cast(kind).alias(VAL), "_open", F.lit(0).alias("_entry"))
    rows = marks.union(v.rows.select(m, VAL, F.lit(0).cast("long"), F.lit(1)))
    swept = running_sum(with_position(rows, [m, "_entry"], "_pos"), "_pos", "_open", "_in")
    return Tensor(swept.filter((F.col("_entry") == 1) & (F.col("_in") == 0)).select(m, VAL), v.modes, v.shape)


def size_classes(corpus: DataFrame, n: int = 50) -> DataFrame:
    """The n smallest, n middle and n largest matrices by dense size (name breaks ties): name, size, class."""
    sized = corpus.select("name", (F.col("dim1") * F.col("dim2")).alias("size"))
    total = sized.count()
    first = max(0, (total - n) // 2)
    pos = F.col("_pos")
    mine = {"small": pos < n, "median": (pos >= first) & (pos < first + n), "large": pos >= total - n}
    # numbered by range partitions, as the middle of a large corpus is no one task's work
    placed = with_position(sized, ["size", "name"], "_pos").withColumn("class", F.array_compact(F.array(*[F.when(c, k) for k, c in mine.items()])))
    return placed.select("name", "size", F.explode("class").alias("class"))


def sample_benchmarks(classes: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """n names of each class, in a digest's order, the same for the same seed."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), "name"))
    w = Window.partitionBy("class").orderBy(place, "name")
    return classes.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def partition_work(names: DataFrame, n: int = 8) -> DataFrame:
    """Names, in order, in n even chunks; the last takes the rest."""
    total = names.count()
    per = max(1, total // n)
    placed = with_position(names.select("name"), ["name"], "_pos")
    return placed.select("name", F.least(F.floor(F.col("_pos") / per), F.lit(n - 1)).cast("long").alias("chunk"))


def result_curves(results: DataFrame, x: str, y: str, by: Sequence[str], filters: Mapping[str, object] | None = None) -> DataFrame:
    """The table behind a curve: the mean of y for each x and group, in order."""
    for k, v in (filters or {}).items():
        results = results.filter(F.col(k) == F.lit(v))
    return results.groupBy(*by, x).agg(F.avg(y).alias(y)).orderBy(*by, x)


def matmul_cost(b: Tensor, c: Tensor) -> DataFrame:
    """Partial products for each contracted coordinate: k, b_count, c_count, products."""
    (k,) = [m for m in b.modes if m in c.modes]
    x = b.df.groupBy(k).agg(F.count(F.lit(1)).alias("b_count"))
    y = c.df.groupBy(k).agg(F.count(F.lit(1)).alias("c_count"))
    return x.join(y, k).withColumn("products", F.col("b_count") * F.col("c_count"))


def product_rows(b: Tensor, c: Tensor, lg: int = 12) -> DataFrame:
    """Entries of every row of the product B C before it is made: i, entries.

    Each row of C becomes a sketch of its columns (the 2**lg smallest digests at most); sketches of the rows that a row of B names are
    merged, first within tasks, and estimate how many columns their union has. Up to 2**lg columns the number is exact, beyond it the
    standard error is about 2**(-lg / 2).
    """
    (k,) = [m for m in b.modes if m in c.modes]
    i, j = next(m for m in b.modes if m != k), next(m for m in c.modes if m != k)
    rows = c.df.groupBy(k).agg(F.theta_sketch_agg(j, F.lit(lg)).alias("_s"))
    merged = b.df.select(i, k).join(rows, k).groupBy(i).agg(F.theta_union_agg("_s", F.lit(lg)).alias("_s"))
    return merged.select(i, F.theta_sketch_estimate("_s").alias("entries"))
