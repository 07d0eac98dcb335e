"""Exact top-k search by inner product, with MaxScore over shards of the vectors.

Components become integers. A dimension and a sign are a term: its postings are the rows whose component has that
sign, kept as a dense column, as most rows have most terms. What a query gets from a term is at most its
weight times the greatest component of a block of rows. With a query's terms in the order of these bounds, the weakest ones whose
bounds together stay below the k-th best score so far are non-essential: a row that has only those can't
compete. The essential columns are traversed, strongest first, then the others are probed for rows that can still
reach the k-th score; rows drop out as soon as what they have plus the bounds of what is left falls short. Rows
that tie with the k-th score are never dropped, so the result is exact.

Rows are dealt to shards and queries to blocks of bounded size; each pair of a shard and a block of queries is one group, which returns k
rows a query at most, and a window merges the shards. Every shard sees every block of queries, as the query set is stated; no
other pairs of rows are made.

Cases: vectors that are null or hold null, NaN or infinite components take no part, neither as rows nor as queries; a shorter
vector has zeros behind it; scores are summed exactly whatever their size and held to the range of a long before they are ranked; rows under the
query's own id are the query's own; queries without an id have no own rows and aren't found by the registered query; candidates without an id come last among ties; equal
rows are separate candidates and may take several ranks, equal queries are one; a query with fewer candidates returns all; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Factor by which components become integers.
SCALE = 256
#: Rows of a shard, at least (where there are too few for every task) and at most; queries of a block.
LEAST_ROWS, MOST_ROWS, MOST_QUERIES = 2048, 65_536, 4096
#: Rows whose bounds are taken together, and terms between two looks at what can still compete.
BLOCK, STEP = 4096, 8
LONG = np.iinfo(np.int64)


def whole_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    v = F.col(vector)
    return df.filter(v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * component), in doubles."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def matrix_of(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Lists of longs as rows of a matrix, with zeros behind short ones."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(col.offsets.to_numpy()).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(col), width), np.int64)
    rows = np.repeat(np.arange(len(col)), size)
    out[rows, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = col.flatten().to_numpy()
    return out


def exact_kind(rows: np.ndarray, queries: np.ndarray) -> type:
    """The smallest number type in which every partial score is exact."""
    if not rows.size or not queries.size:
        return np.float64
    most = max(abs(int(rows.max())), abs(int(rows.min()))) * max(abs(int(queries.max())), abs(int(queries.min()))) * rows.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


class Shard:
    """Columns of a shard's rows in blocks, with the least and greatest component of each column of a block."""

    def __init__(self, ids: np.ndarray, has_id: np.ndarray, rows: np.ndarray, kind: type) -> None:
        self.ids, self.has_id = ids, has_id
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted = ids[self.by_id]
        self.blocks = []
        for a in range(0, len(rows), BLOCK):
            columns = np.ascontiguousarray(rows[a : a + BLOCK].T).astype(kind)
            self.blocks.append((a, columns, np.maximum(columns.max(axis=1), 0), np.minimum(columns.min(axis=1), 0)))

    def own(self, query_id: int | None) -> np.ndarray:
        if query_id is None:
            return np.empty(0, np.int64)
        found = self.by_id[np.searchsorted(self.sorted, query_id) : np.searchsorted(self.sorted, query_id, "right")]
        return found[self.has_id[found]]

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of these rows: higher scores, then smaller ids, rows without an id last."""
        order = np.lexsort((self.ids[at], ~self.has_id[at], -scores))[:k]
        return at[order], scores[order]

    def search(self, query_id: int | None, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best."""
        own = self.own(query_id)
        top, scores = np.empty(0, np.int64), np.empty(0, query.dtype)
        for a, columns, high, low in self.blocks:
            bar = scores[-1] if len(scores) == k and scores[-1] > LONG.min else -math.inf
            bounds = np.where(query > 0, query * high, query * low)
            order = np.argsort(bounds, kind="stable")
            upto = np.cumsum(bounds[order])
            weak = int(np.count_nonzero(upto < bar))
            if len(order) and weak == len(order):
                continue  # not even all terms together reach the k-th score
            at, got = None, np.zeros(columns.shape[1], columns.dtype)
            edges = [(max(e - STEP, weak), e) for e in range(len(order), weak, -STEP)]  # essential terms
            edges += [(max(e - STEP, 0), e) for e in range(weak, 0, -STEP)]  # the others, while rows compete
            for b, e in edges:
                terms = order[b:e]
                got = got + query[terms] @ (columns[terms] if at is None else columns[np.ix_(terms, at)])
                left = upto[b - 1] if b else 0
                able = got + left >= bar
                if np.count_nonzero(able) < 0.8 * len(able):
                    at = np.flatnonzero(able) if at is None else at[able]
                    got = got[able]
                    if not len(at):
                        break
            at = (np.arange(columns.shape[1]) if at is None else at) + a
            if got.dtype == object:
                got = np.array([min(max(s, LONG.min), LONG.max) for s in got], dtype=object)
            good = (got >= bar) & ~np.isin(at, own)
            top, scores = self.best(np.concatenate((top, at[good])), np.concatenate((scores, got[good])), k)
        return top, scores


def _search_group(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, queries = matrix_of(left.column("x")), matrix_of(right.column("x"))
        width = max(rows.shape[1], queries.shape[1])
        rows, queries = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (rows, queries))
        kind = exact_kind(rows, queries)
        ids = left.column("vec_id")
        shard = Shard(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(), rows, kind)
        found, scores, owner = [], [], []
        for q, (query_id, query) in enumerate(zip(right.column("query_id").to_pylist(), queries.astype(kind), strict=True)):
            at, got = shard.search(query_id, query, k)
            found.append(at)
            scores += [int(s) for s in got]
            owner.append(np.full(len(at), q))
        at, owner = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (found, owner))
        return pa.table([right.column("query").take(owner), right.column("query_id").take(owner), ids.take(at), pa.array(scores, pa.int64())], ["query", "query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, most_rows: int = MOST_ROWS, most_queries: int = MOST_QUERIES) -> DataFrame:
    """The k rows of highest integer inner product for every query: query_id, rank, vec_id, score.

    Both tables need vec_id (long) and embedding. Shards and blocks hold ``most_rows`` and ``most_queries`` at most on average; their number grows with the tables.
    """
    spark = vectors.sparkSession
    own = lambda df: whole_vectors(df).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("x"))
    # numbers that a written table keeps deal rows evenly, copies of a row included
    kept = staged(own(vectors).withColumn("deal", F.xxhash64(F.monotonically_increasing_id())), "vectors")
    asked = staged(own(queries).distinct().withColumnRenamed("vec_id", "query_id").withColumn("query", F.monotonically_increasing_id()), "queries")
    n, m = kept.count(), asked.count()
    shards = max(math.ceil(n / most_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LEAST_ROWS)), 1)
    blocks = max(math.ceil(m / most_queries), 1)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = kept.withColumn("shard", F.pmod("deal", F.lit(shards))).select("vec_id", "x", "shard", every(blocks).alias("block"))
    right = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))).select("query", "query_id", "x", "block", every(shards).alias("shard"))
    cell = (F.col("shard") * F.lit(blocks) + F.col("block")).cast("long").alias("cell")
    left, right = left.select(cell, "vec_id", "x").groupBy("cell"), right.select(cell, "query", "query_id", "x").groupBy("cell")
    found = left.cogroup(right).applyInArrow(_search_group(k), "query long, query_id long, vec_id long, score long")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
