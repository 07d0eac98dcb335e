"""Near-duplicate classes by fast similarity sketching, banding and exact verification.

A text's set holds the 64-bit hashes of its distinct word shingles. The sketch has T
coordinates filled in rounds: in round i < T every element goes to the bin that its i-th hash
names, with the value i + fraction; in round T + j every element is offered to bin j. Each bin
keeps its least value, and rounds end once all bins are full, so every coordinate is filled
and equal coordinates estimate the Jaccard similarity with concentration.

Bands of R coordinates name buckets. Texts with equal sets are one class from the start and
only its smallest id goes on. In the buckets of a few bands every member is held against the
smallest id (never all pairs); what is confirmed on the full sets is joined into components. In
buckets of any band that still touch several components, the members outside the bucket's largest
component are held against one member of that (once; more turns found next to nothing). What is left then, the pairs of
different components in a bucket, goes through a filter by size and sketch bits (four of each
coordinate) in the join itself and is confirmed, so that no link is lost to the stars. The pairs of a bucket are
dealt over a grid of cells of about ``POPULAR`` pairs, each pair in one cell, so that a large bucket is many tasks'
work; how many cells there are changes no result. At similarity 0.8 a pair shares no bucket with probability 3e-6,
and fails the bit filter with 3e-6, whatever the size of the buckets.

Cases: null or empty text, or none with a word: an empty set, linked with nothing, kept; fewer
words than the shingle: the whole sequence is the one shingle; ids may be of any type that sorts; rows of an id are one document
in ``near_duplicates`` (it takes one of their texts, and all rows get its component), whereas ``drop_near_duplicates`` tells rows with
different texts apart and keeps one of rows that are equal in id and text; a null id links with nothing and is kept by the former, and is an id
like others (before all) to the latter; ties: the smallest id stays; an empty table gives an empty result; a very long text is sketched
whole, in its own chunk; other columns play no part and are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import discard
from .common import LOWER, SPACE_SEPARATED, columns_of, distinct_in_rows, fresh, hashes, list_column, mix, row_of, runs, staged, text_chunks

WORDS, PERCENT = 5, 80
#: Coordinates of a sketch, coordinates of a band.
T, R, BANDS = 1024, 6, 42
#: The most coordinates in which one bit, or any of four bits, of two similar texts differ.
FAR_BITS, FAR_COORDINATES, PLANES = 146, 250, 4
#: Comparisons in a cell of a bucket's grid, about; a bucket of fewer is one cell.
POPULAR = 1 << 24
#: Bands whose stars are joined first; turns in which what is left is held against the largest component of its bucket.
FIRST_BANDS, ROUNDS = 6, 1
#: Hashes that are taken at once.
AT_ONCE = 1 << 16


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-word shingles as sorted 64-bit hashes, and their offsets."""
    low = LOWER[data]
    starts, ends, wofs = runs(SPACE_SEPARATED[low], offs)
    h = hashes(low, starts, ends)
    count = np.diff(wofs)
    # one shingle for 1 to n words; else count - n + 1
    per = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    sofs = np.concatenate([[0], np.cumsum(per)])
    first = wofs[:-1][row_of(sofs)] + np.arange(sofs[-1]) - sofs[:-1][row_of(sofs)]
    length = np.minimum(count, n)[row_of(sofs)]
    acc = length.astype(np.uint64)
    h = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        step = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[first + k])
        acc = np.where(k < length, step, acc)
    return distinct_in_rows(acc, sofs)


def sketch(elements: np.ndarray, offs: np.ndarray, t: int = T) -> np.ndarray:
    """The sketches (rows x t, t a power of two) of sets without repeats; rows of empty sets are full of the greatest value.

    Several rounds are done at once where few elements are left; more rounds than a row needs change
    nothing, as earlier rounds' values are less.
    """
    docs, empty = len(offs) - 1, np.uint64(2**64 - 1)
    out = np.full((docs, t), empty, dtype=np.uint64)
    x, rows, i = elements, row_of(offs), 0
    while len(x) and i < 2 * t:
        rounds = np.arange(i, min(i + max(1, AT_ONCE // len(x)), t if i < t else 2 * t))
        h = mix(x ^ (rounds.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)))
        at = rows * t + (((h >> np.uint64(32)) & np.uint64(t - 1)).astype(np.int64) if i < t else rounds[:, None] - t)
        h &= np.uint64(0xFFFFFFFF)
        h |= rounds.astype(np.uint64)[:, None] << np.uint64(40)
        np.minimum.at(out.reshape(-1), at.ravel(), h.ravel())
        i = int(rounds[-1]) + 1
        open_ = np.unique(rows)
        left = np.zeros(docs, dtype=bool)
        left[open_] = (out[open_] == empty).any(axis=1)
        go = left[rows]
        if not go.all():
            x, rows = x[go], rows[go]
    return out


SKETCH = "n_shingles long, set_a long, set_b long, bands array<long>, bits array<long>"


def _named(coordinates: np.ndarray, r: int) -> np.ndarray:
    """A hash of every r coordinates, and their place (rows x groups)."""
    rows, n = len(coordinates), coordinates.shape[1] // r
    acc, part = np.broadcast_to(np.arange(n, dtype=np.uint64), (rows, n)), coordinates.reshape(rows, n, r)
    for k in range(r):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k])
    return acc.astype(np.uint64).view(np.int64)


def _sketches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text"), 1 << 20):
                v, vofs = shingles(data, offs, n)
                size = np.diff(vofs)
                total = np.zeros((2, len(v) + 1), dtype=np.uint64)
                np.cumsum(mix(v), out=total[0, 1:])
                np.cumsum(mix(v ^ np.uint64(0xA5A5A5A5)), out=total[1, 1:])
                key = mix(total[:, vofs[1:]] - total[:, vofs[:-1]] + size.astype(np.uint64))
                s = sketch(v, vofs)
                bands = _named(s[:, : BANDS * R], R)
                m = mix(s + np.uint64(77))
                bits = np.concatenate([np.packbits((m >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for k in range(PLANES)], axis=1)
                lists = [list_column(x.ravel(), np.arange(b - a + 1) * x.shape[1], pa.int64()) for x in (bands, bits)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(size), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), *lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text")):
                v, vofs = shingles(data, offs, n)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), list_column(v.view(np.int64), vofs, pa.int64())], names=["id", "items"])

    return run


def _alike(a: str, b: str, percent: int, *besides: Column) -> Column:
    """May two texts be similar: by their sizes, by one sketch bit of each coordinate, and by all of them; what else a pair needs is asked before the last, which costs most."""
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    words = T // 64
    xor = lambda k: F.col(f"{a}_bits")[k].bitwiseXOR(F.col(f"{b}_bits")[k])
    differ = reduce(lambda x, y: x + y, [F.bit_count(xor(k)) for k in range(words)])
    all_planes = F.aggregate(F.sequence(F.lit(0), F.lit(words - 1)), F.lit(0), lambda n, k: n + F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [xor(k + words * p) for p in range(PLANES)])))
    return reduce(lambda x, y: x & y, [F.least(n, m) * 100 >= F.greatest(n, m) * percent, differ <= FAR_BITS, *besides, all_planes <= FAR_COORDINATES])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full sets have 100 * intersection >= percent * union."""
    left, right = sets.select(F.col("id").alias("x"), F.col("items").alias("p")), sets.select(F.col("id").alias("y"), F.col("items").alias("q"))
    both = F.size(F.array_intersect("p", "q"))
    return pairs.join(left, "x").join(right, "y").filter(100 * both >= percent * (F.size("p") + F.size("q") - both)).select("x", "y")


def components(edges: DataFrame, most: int = 500) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of an edge (x, y).

    In each round a vertex and the root that it points to both take the least label around the vertex,
    and labels then jump to their label's label, so rounds grow with the logarithm of a chain's
    length whatever its order. Each round is staged; the driver sees one count. It ends
    once nothing changes, and fails rather than return unfinished labels.
    """
    both = staged(edges.select(F.col("x").alias("u"), F.col("y").alias("v")).union(edges.select("y", "x")).distinct(), "edges")
    label = staged(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "label")
    for _ in range(most):
        near = both.join(label, both["v"] == label["id"]).groupBy("u").agg(F.min("component").alias("m"))
        seen = label.join(near, label["id"] == near["u"]).select("id", "component", F.least("component", "m").alias("m"))
        hooks = seen.select("id", "m").union(seen.select("component", "m")).groupBy(F.col("id").alias("u")).agg(F.min("m").alias("m"))
        step = label.join(hooks, label["id"] == hooks["u"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        top = step.select(F.col("id").alias("t"), F.col("component").alias("up"))
        new = staged(step.join(top, step["component"] == top["t"], "left").select("id", "old", F.least("component", "up").alias("component")), "label")
        discard(label)
        label = new.select("id", "component")
        label._staged_at = new._staged_at
        if not new.filter("old <> component").limit(1).count():
            discard(both)
            return label
    raise RuntimeError(f"components aren't finished after {most} rounds")


def _mixed(members: DataFrame, joined: DataFrame, turn: int) -> DataFrame:
    """(band, id, component, hub, rep) of the buckets that several components share: the bucket's largest component and one of its members, another one each turn."""
    labelled = members.join(joined, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    parts = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "band", F.lit(turn)).alias("h"), "id")).alias("one"))
    hubs = parts.groupBy("band").agg(F.max(F.struct("n", "component", F.col("one.id").alias("rep"))).alias("hub"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return staged(labelled.join(hubs.select("band", F.col("hub.component").alias("hub"), F.col("hub.rep").alias("rep")), "band"), "mixed")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    texts = docs.select("doc_id", "text")
    kind = dict(texts.dtypes)["doc_id"]
    made = staged(texts.mapInArrow(_sketches(words), f"doc_id {kind}, {SKETCH}"), "sketch")
    slim = made.select("doc_id", "n_shingles", "set_a", "set_b")
    some = made.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # classes of equal sets; only those of two rows or more are kept as a table
    classes = staged(some.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"), "classes")
    of_class = staged(slim.join(classes, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")), "members")
    # one row for each class: the first of the representative's rows
    reps = some.join(classes, ["set_a", "set_b"], "left").filter("rep IS NULL OR rep = doc_id")
    held = reps.select("doc_id", "n_shingles", "bands", "bits")
    bucket = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("no", "band"))
    # one plan for every size: the buckets of several members are few, but grow with the input
    ends = staged(bucket.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").drop("high"), "ends")
    members = staged(bucket.hint("merge").join(ends, "band"), "buckets")
    facts = staged(held.join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "facts")
    sets = staged(texts.join(facts.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_full_sets(words), f"id {kind}, items array<long>"), "sets")
    side = lambda k: facts.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"))
    likely = lambda pairs: pairs.distinct().join(side("x"), "x").join(side("y"), "y").filter(_alike("x", "y", percent)).select("x", "y")
    found = lambda pairs: staged(confirmed(staged(pairs, "pairs"), sets, percent), "links")
    joined = components(found(likely(members.filter(F.col("no") < FIRST_BANDS).select(F.col("low").alias("x"), F.col("id").alias("y")).filter("x < y"))))
    open_ = members.select("band", "id")
    for turn in range(ROUNDS):
        open_ = _mixed(open_.select("band", "id"), joined, turn)
        star = open_.filter("component <> hub").select(F.least("rep", "id").alias("x"), F.greatest("rep", "id").alias("y"))
        more = found(likely(star))
        if not more.limit(1).count():
            break
        joined = components(joined.select(F.col("id").alias("x"), F.col("component").alias("y")).filter("x <> y").union(more))
    last = _mixed(open_.select("band", "id"), joined, ROUNDS)
    # a bucket's largest component meets only what is outside of it; each pair is in one cell of the bucket's grid, whose sides are dealt by id
    apart = F.col("component") != F.col("hub")
    blocks = lambda n: F.ceil(n / max(1, isqrt(POPULAR)))
    grid = last.groupBy("band").agg(blocks(F.count_if(apart)).alias("high"), blocks(F.count(F.lit(1))).alias("wide"))
    rows = last.join(grid, "band").join(facts.withColumnRenamed("doc_id", "id"), "id")
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    half = lambda k, rows: rows.select("band", "i", "j", F.col("id").alias(k), F.col("component").alias(f"{k}_c"), (~apart).alias(f"{k}_hub"), F.col("n_shingles").alias(f"{k}_n"), F.col("bits").alias(f"{k}_bits"), F.col("bands").alias(f"{k}_bands"))
    left = half("x", rows.filter(apart).withColumn("i", own(F.col("high"))).withColumn("j", every(F.col("wide"))))
    right = half("y", rows.withColumn("j", own(F.col("wide"))).withColumn("i", every(F.col("high"))))
    # a pair that shares several buckets is compared in the first of them, and two components outside of the largest in one order
    once = F.get(F.array_intersect("x_bands", "y_bands"), F.lit(0)) == F.col("band")
    both = left.join(right, ["band", "i", "j"]).filter((F.col("y_hub") | (F.col("x_c") < F.col("y_c"))) & _alike("x", "y", percent, once))
    more = found(both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    if more.limit(1).count():
        joined = components(joined.select(F.col("id").alias("x"), F.col("component").alias("y")).filter("x <> y").union(more))
    out = of_class.join(joined, of_class["rep"] == joined["id"], "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with the columns of ``docs``."""
    key = fresh(docs, "_key")
    # rows go by id and text, so that an id of several texts is several documents
    keyed = docs.select(*columns_of(docs), F.struct("doc_id", F.xxhash64("text").alias("digest")).alias(key))
    gone = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), words, percent).filter("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    # only equal rows, which are few as a rule, are brought together
    again = staged(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), "again")
    single = keyed.join(gone.union(again), key, "left_anti")
    return single.union(keyed.join(again, key, "left_semi").join(gone, key, "left_anti").dropDuplicates([key]).select(*single.columns)).select(*columns_of(docs))
