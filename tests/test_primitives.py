"""Directed fixtures of the primitives, as coordinate rows."""

import pytest
from pyspark.sql import functions as F

from loomgrid.functions.scalars import cast_trunc, round_sparse
from loomgrid.operators import bits, elementwise, joins, reductions
from loomgrid.tensor import Tensor, from_rows


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def vec(spark, coords, name="i", size=None):
    return from_rows(spark, [(c, c + 1) for c in coords], [name], None if size is None else (size,))


def test_intersect_two_levels(spark):
    a = from_rows(spark, [(0, 0, 1), (1, 0, 1), (1, 1, 1), (1, 2, 1)], ["i", "j"])
    b = from_rows(spark, [(0, 0, 1), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 1, 1), (1, 2, 1)], ["i", "j"])
    assert rows(joins.intersect(a, b), "i", "j") == [(0, 0), (1, 0), (1, 1), (1, 2)]


@pytest.mark.parametrize("n", [4, 16, 32, 64])
def test_intersect_one_level(spark, n):
    b = [0, 2, 4, 15, 17, 25, 31, 32, 50, 63]
    assert rows(joins.intersect(vec(spark, range(n)), vec(spark, b)), "i") == [(x,) for x in b if x < n]


def test_union_fills(spark):
    got = joins.union(vec(spark, [0, 1, 3, 5]), vec(spark, [0, 2, 3, 4]))
    assert rows(got, "i", "val_a", "val_b") == [(0, 1, 1), (1, 2, 0), (2, 0, 3), (3, 4, 4), (4, 0, 5), (5, 6, 0)]


def test_reduce(spark):
    fibers = [[5, 5], [5], [4, 8], [4, 3], [4, 3]]
    t = from_rows(spark, [(i, j, v) for i, f in enumerate(fibers) for j, v in enumerate(f)], ["i", "j"])
    assert rows(reductions.reduce_modes(t, ["j"]).df, "i", "val") == [(0, 10), (1, 5), (2, 12), (3, 7), (4, 7)]
    assert rows(reductions.reduce_all(from_rows(spark, [(k, k) for k in range(1, 10)], ["i"])).df, "val") == [(45,)]
    assert rows(reductions.reduce_all(from_rows(spark, [], ["i"])).df, "val") == [(0,)]


def test_accumulate(spark):
    o, i, v = [0, 0, 0, 2, 2, 2, 2, 2, 2], [0, 2, 3] * 3, [50, 5, 10, 40, 4, 8, -40, 33, 36]
    df = spark.createDataFrame(list(zip(o, i, v)), "o long, i long, val long")
    assert rows(reductions.accumulate_vector(df, "o", "i"), "o", "i", "val") == [(0, 0, 50), (0, 2, 5), (0, 3, 10), (2, 0, 0), (2, 2, 37), (2, 3, 44)]
    c1, c0 = [0, 2, 3, 0, 0, 2, 2, 2, 3, 3, 3, 3, 3, 0], [0, 2, 3, 0, 2, 0, 0, 3, 0, 2, 3, 0, 2, 0]
    v = [50, 5, 10, 40, 4, 8, -40, 33, 36, 1, 2, 3, 4, 5]
    df = spark.createDataFrame(list(zip(c1, c0, v)), "a long, b long, val long")
    assert rows(reductions.accumulate_matrix(df, ["a", "b"]).df, "a", "b", "val") == [(0, 0, 95), (0, 2, 4), (2, 0, -32), (2, 2, 5), (2, 3, 33), (3, 0, 39), (3, 2, 5), (3, 3, 12)]


def test_drop_empty_outer_and_repeat(spark):
    outer = spark.createDataFrame([(0,), (1,), (2,), (3,)], "i long")
    inner = spark.createDataFrame([(0, 1), (1, 1), (3, 1)], "i long, j long")
    assert rows(joins.drop_empty_outer(outer, inner, ["i"]), "i") == [(0,), (1,), (3,)]
    held = joins.repeat(vec(spark, [0, 1, 2]), spark.createDataFrame([(0, 0), (0, 2), (1, 2), (2, 2)], "i long, j long"))
    assert rows(held.df, "i", "j") == [(0, 0), (0, 2), (1, 2), (2, 2)]


def test_split_and_flatten(spark):
    t = vec(spark, [0, 2, 3, 9, 11, 12], size=16)
    four = elementwise.split(t, "i", 4)
    assert rows(four.df, "i0", "i") == [(0, 0), (0, 2), (0, 3), (2, 9), (2, 11), (3, 12)]
    three = elementwise.split(t, "i", 3, original=False)
    assert rows(three.df, "i0", "i") == [(0, 0), (0, 2), (1, 0), (3, 0), (3, 2), (4, 0)]
    assert rows(elementwise.flatten(three, "i0", "i", 3).df, "i") == rows(t.df, "i")


def test_shift(spark):
    t = from_rows(spark, [(0, 0, 7), (0, 3, 8)], ["i", "j"], (1, 4))
    assert rows(elementwise.shift_last_mode(t).df, "i", "j", "val") == [(0, 0, 2), (0, 1, 2)]
    t3 = from_rows(spark, [(0, 0, 0, 5), (0, 0, 1, 6), (0, 0, 3, 1)], ["i", "j", "k"], (1, 1, 4))
    assert rows(elementwise.shift_last_mode(t3).df, "k", "val") == [(1, 2), (3, 2)]
    assert rows(elementwise.shift_last_mode(t3, on_collision="sum").df, "k", "val") == [(1, 4), (3, 2)]


def test_casts(spark):
    df = spark.createDataFrame([(0.0,), (0.4,), (-0.4,), (1.5,), (-1.5,), (2.4,)], "x double")
    assert [r[0] for r in df.select(round_sparse(F.col("x"))).collect()] == [1, 1, -1, 2, -2, 2]
    assert [r[0] for r in df.select(cast_trunc(F.col("x"))).collect()] == [1, 1, 1, 1, -1, 2]
    assert [r[0] for r in df.select(cast_trunc(F.col("x"), False)).collect()] == [0, 0, 0, 1, -1, 2]


def test_bitvectors(spark):
    t = vec(spark, [0, 2, 3, 9, 11, 12])
    assert rows(bits.to_bitvector(t, 4), "word_id", "word") == [(0, 0b1101), (2, 0b1010), (3, 0b0001)]
    words = spark.createDataFrame([(0, 0b1011), (1, 0b0101), (2, 0b1000)], "word_id long, word long")
    assert rows(bits.bit_refs(words), "word_id", "ref") == [(0, 0), (1, 3), (2, 5)]
    assert rows(bits.from_bitvector(bits.to_bitvector(t, 4), (), "i", 4), "i") == rows(t.df, "i")
    a, b = (spark.createDataFrame([(0, w)], "word_id long, word long") for w in (0b1101, 0b1100))
    assert rows(bits.intersect_bits(a, b, width=4), "bit", "ref_a", "ref_b") == [(2, 1, 0), (3, 2, 1)]
    outer = spark.createDataFrame([(0, 0b1100)], "word_id long, word long")
    inner = spark.createDataFrame([(2, 0b1000), (3, 0)], "i long, word long")
    assert rows(bits.bv_drop(outer, inner, "i", 4), "word") == [(0b0100,)]


def test_tensor_checks_columns(spark):
    with pytest.raises(ValueError):
        Tensor(spark.createDataFrame([(1,)], "i long"), ("i",))


def test_drawn_cells_are_counted_without_a_shuffle(spark, monkeypatch):
    """Partitions of rising cells that don't overlap prove that all differ; anything else is counted."""
    from loomgrid.operators import check, generate
    from loomgrid.tensor import Tensor, from_rows

    t = generate.random_tensor(spark, ("i", "k"), (500, 4000), 0.98, 5)
    n = t.df.count()
    with monkeypatch.context() as m:
        m.setattr(check.F, "count_distinct", None)  # the proof is enough
        assert check.drawn_cells(t) == (n, n, 0)
    assert check.drawn_cells(Tensor(t.df.union(t.df), t.modes, t.shape)) == (2 * n, n, 0)
    assert check.drawn_cells(from_rows(spark, [(0, 1, 1), (0, 0, 1), (1, 0, 0), (0, 5, 1), (0, 1, 2)], ["i", "k"], (2, 5))) == (5, 4, 2)
    assert check.drawn_cells(from_rows(spark, [], ["i", "k"], (2, 5))) == (0, 0, 0)
