"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size.
The documents of a source stand in a fixed order (size, a digest of the id, the id); the
running sum of expected copies plus one offset per source is cut at the integers, and a
document is emitted once for each integer that its share crosses. As neighbours have
about the same size, the words taken come near the target.

Running sums are taken in three levels (source and size; digest prefix; row), so that no
task holds a whole source: a hot source is spread by size, and a hot size by the digest.

Cases: a null or empty text has size 0 and takes 0 words; a null source is a source of
its own, last in order; repeated rows are separate documents, each with its own place; documents without an id are
spread by their text; ties in size, digest and id go by the text's hash; a very long text is counted whole; an empty table gives an
empty result; extra columns are left out by ``mix_plan`` and kept, whatever their names, by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, staged

#: Weights that the sources take in turn, in code-point order of their names.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words; the most copies of a document.
BUDGET, MOST = 1.5, 2.0
#: Digits of the digest that spread rows of equal source and size.
DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source: Column, seed: int) -> Column:
    """The source's one offset in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Each source's target: its weighted share of ``budget`` times all words, at most ``most`` times its size.

    ``sizes`` has one row per source (a bounded table of names). What a full source can't take is
    shared among the others by weight: with the sources ordered by cap / weight, the level is the one
    left by the shortest run of full sources. Sources of no words get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    full = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    x = (
        x.withColumn("total", F.lit(budget) * F.sum("source_size").over(every))
        .withColumn("capped", F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.coalesce("capped", F.lit(0.0))) / F.col("open"))
        # the first source, in this order, that the level doesn't fill: from there on the level holds
        .withColumn("level", F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("cap") / F.col("w"))).over(every))
    )
    return x.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _digest() -> Column:
    """The digest that spreads documents of equal source and size: of the id, or of the text where there is none."""
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))), 1, DIGITS)


def _cell(source: Column, size: Column, digest: Column) -> Column:
    """A name for the cell of a source, size and digest, without nulls."""
    return F.concat_ws(":", size, digest, F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))


def _cells(slim: DataFrame, weights: tuple[float, ...], budget: float, most: float) -> DataFrame:
    """One row per cell: (cell, before, source_size, target), with the number of documents that stand before it in its source."""
    cell = slim.groupBy("source", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    by_size = cell.groupBy("source", "size").agg(F.sum("n").alias("m"))
    source = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).cast("long").alias("source_size")), weights, budget, most)
    by_size = by_size.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size_side = by_size.join(source.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).select(F.col("source").alias("s1"), F.col("size").alias("z1"), "before", "source_size", "target")
    inside = Window.partitionBy("source", "size").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    return (
        cell.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(size_side, F.col("source").eqNullSafe(F.col("s1")) & (F.col("size") == F.col("z1")))
        .select(_cell(F.col("source"), F.col("size"), F.col("h")).alias("cell"), (F.col("before") + F.col("within")).alias("before"), "source_size", "target")
    )


def _copies(place: Column, source: Column, most: float, seed: int) -> Column:
    """How many integers the share of the document at ``place`` crosses."""
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(F.lit(0.0))
    offset = offset_of(source, seed)
    return (F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)).cast("long")


def _slim(docs: DataFrame) -> DataFrame:
    return staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _digest().alias("h"), F.xxhash64("text").alias("t")), "mix")


def mix_plan(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: what the mix takes of each document."""
    slim = _slim(docs)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("doc_id").asc_nulls_last(), "t"))
    ranked = slim.withColumn("cell", _cell(F.col("source"), F.col("size"), F.col("h"))).withColumn("r", rank).join(_cells(slim, weights, budget, most), "cell")
    ranked = ranked.withColumn("copies", _copies(F.col("before") + F.col("r"), F.col("source"), most, seed))
    return ranked.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 7) -> DataFrame:
    """The documents of the mix: each row as often as the plan takes it, with the columns of ``docs``.

    Rows are numbered in their cell as in the plan; the texts are shuffled once, for that.
    """
    row = docs.select(F.struct(*columns_of(docs)).alias("row"), "doc_id", "source", F.xxhash64("text").alias("t"), _cell(F.col("source"), word_count(F.col("text")), _digest()).alias("cell"))
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.col("doc_id").asc_nulls_last(), "t"))
    placed = row.withColumn("r", rank).join(_cells(_slim(docs), weights, budget, most), "cell")
    copies = _copies(F.col("before") + F.col("r"), F.col("source"), most, seed)
    return placed.select("row", copies.cast("int").alias("n")).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])
