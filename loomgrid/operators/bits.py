"""Bitvector index of coordinates: one long word per fiber and run of ``width`` coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged
from ..tensor import VAL, Tensor
from .formats import running_sum


def to_bitvector(t: Tensor, width: int = 63) -> DataFrame:
    """(outer modes, word_id, word): bit crd mod width of word crd div width is set."""
    if not 1 <= width <= 63:
        raise ValueError("a word has 1 to 63 bits")
    last = t.modes[-1]
    return t.df.groupBy(*t.modes[:-1], F.floor(F.col(last) / width).cast("long").alias("word_id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(last, F.lit(width)).cast("int"))).alias("word"))


def bit_refs(words: DataFrame, fiber: Sequence[str] = ()) -> DataFrame:
    """Offset of each word's first bit in its fiber's values: set bits of the words before it. A long fiber is summed by blocks in many tasks."""
    out = running_sum(words, "word_id", F.bit_count("word"), "ref", fiber=fiber)
    return out.select(*words.columns, F.col("ref").cast("long").alias("ref"))


def from_bitvector(words: DataFrame, fiber: Sequence[str], mode: str, width: int = 63) -> DataFrame:
    """Coordinates of the set bits."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.col("word").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
    return words.select(*fiber, "word_id", F.explode(bits).alias("_bit")).select(*fiber, (F.col("word_id") * width + F.col("_bit")).alias(mode))


def bv_drop(outer: DataFrame, inner: DataFrame, mode: str, width: int = 63) -> DataFrame:
    """Outer bits whose inner word is empty are cleared, words without bits dropped.

    ``inner`` has a row (``mode``, word) for each set outer bit.
    """
    coords = from_bitvector(outer, (), mode, width).join(inner.filter("word <> 0").select(mode).distinct(), mode, "left_semi")
    return to_bitvector(Tensor(coords.withColumn(VAL, F.lit(1)), (mode,)), width)


def intersect_bits(a: DataFrame, b: DataFrame, fiber: Sequence[str] = (), width: int = 63) -> DataFrame:
    """(fiber, word_id, bit, ref_a, ref_b): common coordinates with the positions of their values on both sides."""
    x = bit_refs(a, fiber).select(*fiber, "word_id", F.col("word").alias("wa"), F.col("ref").alias("ra"))
    y = bit_refs(b, fiber).select(*fiber, "word_id", F.col("word").alias("wb"), F.col("ref").alias("rb"))
    both = x.join(y, [*fiber, "word_id"]).withColumn("word", F.col("wa").bitwiseAND(F.col("wb"))).filter("word <> 0")
    mask = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    bits = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.col("word").bitwiseAND(mask(k)) != 0)
    rows = both.withColumn("bit", F.explode(bits))
    lower = lambda w, r: F.col(r) + F.bit_count(F.col(w).bitwiseAND(mask(F.col("bit")) - 1))
    return rows.select(*fiber, "word_id", "bit", lower("wa", "ra").alias("ref_a"), lower("wb", "rb").alias("ref_b"))


def with_refs(t: Tensor) -> DataFrame:
    """Values with their position in each fiber, counted along the last mode, by blocks of it."""
    out = running_sum(t.rows, t.modes[-1], F.lit(1), "ref", fiber=t.modes[:-1])
    return out.select(*t.modes, VAL, F.col("ref").cast("long").alias("ref"))


def elemmul_bittree(b: Tensor, c: Tensor, factor: int = 32, levels: int = 2) -> Tensor:
    """Elementwise product by bit trees of ``levels`` levels along the last mode; other modes name the trees.

    The words of a level are intersected where all levels above it have common bits; the values of the last
    level's common bits are found by their references. Below the top a word has ``factor`` bits.
    """
    if levels < 2 or not 2 <= factor <= 63:
        raise ValueError("a tree has at least two levels and words of 2 to 63 bits")
    *outer, mode = b.modes
    digits = [f"_d{k}" for k in range(levels)]

    def split(t: Tensor) -> DataFrame:
        columns = [F.floor(F.col(mode) / factor ** (levels - 1 - k)).cast("long") for k in range(levels)]
        return t.df.select(*outer, *[(x if k == 0 else F.pmod(x, F.lit(factor))).alias(d) for k, (x, d) in enumerate(zip(columns, digits, strict=True))], VAL)

    x, y = split(b), split(c.rename(*b.modes))
    for level in range(levels - 1):
        fiber, d = [*outer, *digits[:level]], digits[level]
        width = factor if level else 63
        words = lambda df: to_bitvector(Tensor(df.select(*fiber, d).distinct().withColumn(VAL, F.lit(1)), (*fiber, d)), width)  # noqa: B023, E731
        common = words(x).withColumnRenamed("word", "_w").join(words(y), [*fiber, "word_id"]).withColumn("word", F.col("word").bitwiseAND(F.col("_w"))).filter("word <> 0")
        alive = from_bitvector(common, fiber, d, width)
        # written, as each level reads the entries that the one above it left several times
        alive = staged(alive, "bits")
        x, y = (staged(df.join(alive, [*fiber, d], "left_semi"), "bits") for df in (x, y))
    fiber, d = [*outer, *digits[:-1]], digits[-1]
    left, right = (Tensor(df, (*fiber, d)) for df in (x, y))
    hit = intersect_bits(to_bitvector(left, factor), to_bitvector(right, factor), fiber, factor)
    refs = lambda t, name, val: with_refs(t).select(*fiber, F.col("ref").alias(name), F.col(VAL).alias(val))
    rows = hit.join(refs(left, "ref_a", "p"), [*fiber, "ref_a"]).join(refs(right, "ref_b", "q"), [*fiber, "ref_b"])
    at = F.col("bit").cast("long")
    for k, name in enumerate(digits[:-1]):
        at = at + F.col(name) * factor ** (levels - 1 - k)
    return Tensor(rows.select(*outer, at.alias(mode), (F.col("p") * F.col("q")).alias(VAL)), b.modes, b.shape)
