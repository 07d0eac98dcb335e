"""Importance resampling towards a target: documents drawn by gain of their words plus Gumbel noise.

Features are the runs of consecutive words, hashed to buckets. A bucket's gain is the floored log ratio of its
smoothed share in the target texts to that in all documents; a document's weight is the floored mean over its
features. Weights come from one array of gains that every task holds (its length is the number of buckets, whatever
the input). Noise from a digest of the id turns the highest scores into a draw without replacement.

The draw is a distributed quickselect: keys drawn at random from what is left are pivots, the rows above, equal to and between
them are counted exactly, and the range that holds the k-th key is kept. Only pivots and counts reach the
driver. The winners alone are then sorted, by ranges, and numbered.

Cases: a null or empty text has no features, weight 0, and is never drawn, as documents with fewer than ``least_words`` aren't; a
null id is hashed as empty text and comes last among ties; ties in score go to the smaller id, then to fewer features; rows
that are equal in all returned columns are separate documents, of which any may be drawn; a very long text is
counted whole; an empty table gives an empty result; an empty target leaves each bucket's smoothed share; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.operators.formats import with_position

from .common import LOWER, lut, row_of, runs, staged, text_chunks

#: Bytes of words: digits, letters (lower-cased before), all beyond ASCII.
IN_WORD = lut((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Buckets of features, percent drawn, words that a drawn document has at least, seed of the noise.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 10, 20, 2024
#: Pivots of one round of the quickselect.
PIVOTS = 31
#: Bytes of a feature that are hashed a column at a time; longer ones are hashed one by one.
SHORT = 48


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each byte range: short ranges together, a byte of each at a time, longest first."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size, at = size[order], starts[order]
    out = np.empty(len(size), np.uint32)
    n_long = int(np.searchsorted(-size, -SHORT))
    for k in range(n_long):
        out[k] = zlib.crc32(data[at[k] : at[k] + size[k]])
    size, at = size[n_long:], at[n_long:]
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for p in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -p))
        c = crc[:n]
        crc[:n] = _CRC[(c ^ data[at[:n] + p]) & 0xFF] ^ (c >> 8)
    out[n_long:] = ~crc
    back = np.empty_like(out)
    back[order] = out
    return back


def features_of(data: np.ndarray, offs: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk of texts: words per row, the bucket of every feature, the row of every feature."""
    low = LOWER[data]
    starts, ends, at = runs(IN_WORD[low], offs)
    words = np.diff(at)
    rows = row_of(at)
    if most > 1 and len(starts):
        # words apart by one space each, so that a run of them is a byte range
        size = ends - starts
        begin = np.concatenate(([0], np.cumsum(size + 1)))
        joined = np.full(begin[-1], 0x20, np.uint8)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        joined[np.repeat(begin[:-1], size) + inside] = low[np.repeat(starts, size) + inside]
        low, starts, ends = joined, begin[:-1], begin[1:] - 1
    found, owner = [], []
    for n in range(1, most + 1):
        first = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :]) if len(rows) >= n else np.empty(0, np.int64)
        found.append(crc32_of(low, starts[first], ends[first + n - 1]) % np.uint32(buckets))
        owner.append(rows[first])
    return words, np.concatenate(found).astype(np.int64), np.concatenate(owner)


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; a task sends at most one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offs in text_chunks(batch.column(0)):
                total += np.bincount(features_of(data, offs, most, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket (``buckets`` numbers reach the driver)."""
    s, t = ([0] * buckets for _ in range(2))
    for counts, table in ((s, docs), (t, target)):
        for bucket, n in bucket_counts(table, most, buckets).collect():
            counts[bucket] = n
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log(((b + 1) * all_s) / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, most: int = 1) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""
    buckets = len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offs in text_chunks(batch.column(1)):
                words, bucket, row = features_of(data, offs, most, buckets)
                n = np.bincount(row, minlength=b - a).astype(np.int64)
                total = np.zeros(b - a, np.int64)
                np.add.at(total, row, gains[bucket])
                weight = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind)] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    return docs.select("doc_id", "text").mapInArrow(score, schema)


def noise(seed: int = SEED) -> Column:
    """1000 times a Gumbel draw, floored, from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def kth_key(table: DataFrame, key: str, k: int, pivots: int = PIVOTS) -> object:
    """The k-th smallest value (from 1) of a key column without nulls, by rounds of random pivots and exact counts.

    Each round reads the column once and returns at most ``pivots`` keys and counts to the driver.
    """
    kind = table.schema[key].dataType
    lit = lambda v: F.lit(v) if not isinstance(kind, T.StructType) else F.struct(*[F.lit(v[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
    left, below, turn = table.select(F.col(key).alias("key")), 0, 0
    while True:
        drawn = left.orderBy(F.xxhash64("key", F.lit(turn))).limit(pivots).distinct()
        marks = F.array_sort(F.collect_list("key"))
        chosen = drawn.agg(marks.alias("p")).first()["p"]
        if not chosen:
            raise ValueError(f"fewer than {k} keys")
        at = F.array(*[lit(p) for p in chosen])
        place = F.size(F.filter(at, lambda p: p < F.col("key")))
        counts = {(i, e): n for i, e, n in left.groupBy(place.alias("i"), F.exists(at, lambda p: p == F.col("key")).alias("e")).count().collect()}
        for i in range(len(chosen) + 1):
            between = counts.get((i, False), 0)
            if below + between >= k:
                low, high = chosen[i - 1] if i else None, chosen[i] if i < len(chosen) else None
                if low is not None:
                    left = left.filter(F.col("key") > lit(low))
                if high is not None:
                    left = left.filter(F.col("key") < lit(high))
                break
            below += between
            if i < len(chosen):
                below += counts.get((i, True), 0)
                if below >= k:
                    return chosen[i]
        else:
            raise ValueError(f"fewer than {k} keys")
        turn += 1


def resample(
    docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    ``docs`` needs doc_id (any type that sorts) and text, ``target`` text. ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    weighed = weigh(docs, gains_of(docs, target, most, buckets), most)
    score = F.col("weight") + noise(seed)
    key = F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("n_features").alias("f"))
    slim = staged(weighed.withColumn("score", score).withColumns({"key": key, "row": F.monotonically_increasing_id()}), "importance")
    out = ["doc_id", "n_features", "weight", "score"]
    able = slim.filter(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    undrawn = F.lit(None).cast("long").alias("rank")
    if not k:
        return slim.select(*out, undrawn)
    last = kth_key(able, "key", k)
    kind = slim.schema["key"].dataType
    wins = (F.col("n_words") >= least_words) & (F.col("key") <= F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kind.fields]))
    # the row's number parts equal keys, so that many copies of a winner aren't one task's rows
    placed = with_position(slim.filter(wins), ["key", "row"], "rank")
    drawn = placed.select(*out, F.when(F.col("rank") < k, F.col("rank") + 1).alias("rank"))
    return drawn.unionByName(slim.filter(~wins).select(*out, undrawn))
