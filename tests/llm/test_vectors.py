"""Top-k search, whitening and importance resampling against plain versions, and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import importance, topk, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score int, rank int, x int, cell int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, 7, 7) for r in rows], VECTORS).repartition(3)


def plain_top(rows, queries, k, scale=256):
    whole = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    asked = {(i, tuple(math.floor(scale * c) for c in v)) for i, v in queries if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = Counter()
    for q, v in asked:
        got = [(-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), i is None, i or 0, i) for i, w in whole if q is None or i != q]
        for r, (s, _, _, i) in enumerate(sorted(got)[:k], 1):
            out[q, r, i, -s] += 1
    return out


def f32(x):
    return float(np.float32(x))


def found(df):
    return Counter(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("most_rows, most_queries", [(65_536, 4096), (40, 7)])
def test_search_is_exact(spark, most_rows, most_queries):
    r = random.Random(most_rows)
    rows = [(k, [f32(r.gauss(0, 0.2)) for _ in range(12)]) for k in range(400)]
    rows += [(k, rows[5][1]) for k in range(1000, 1100)]  # a hot vector: ties go to the smaller id
    rows += [(7, rows[7][1]), (None, rows[9][1]), (None, rows[9][1]), (2000, None), (2010, [1.0, None]), (2020, [math.nan]), (2030, [math.inf]), (2040, []), (2050, [f32(0.5)] * 3)]
    queries = [x for x in rows if x[0] is not None and x[0] % 10 == 0] + [rows[10], (None, rows[3][1])]
    got = topk.search(table(spark, rows), table(spark, queries), 5, most_rows=most_rows, most_queries=most_queries)
    assert found(got) == plain_top(rows, queries, 5)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}


def test_search_drops_rows_of_no_use(spark):
    """Terms that can't matter aren't traversed: only the first column decides."""
    r = np.random.default_rng(1)
    rows = np.zeros((20_000, 16), np.int64)
    rows[:, 0] = np.arange(20_000)[::-1]
    rows[:, 1:] = r.integers(-1, 2, (20_000, 15))
    seen = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            seen.append(other.size)
            return np.asarray(self) @ np.asarray(other)

    shard = topk.Shard(np.arange(20_000), np.ones(20_000, bool), rows, np.float64)
    query = np.ones(16).view(Watched)
    at, scores = shard.search(None, query, 5)
    plain = rows.sum(axis=1)
    order = np.lexsort((np.arange(20_000), -plain))[:5]
    assert at.tolist() == order.tolist() and [int(s) for s in scores] == plain[order].tolist()
    assert sum(seen) < 0.3 * rows.size


def test_search_of_few_huge_and_none(spark):
    rows = [(1, [3e30, 1.0]), (2, [3e30, 2.0]), (3, [-3e30, 0.0]), (50, [1e4, 1e4])]
    got = found(topk.search(table(spark, rows), table(spark, rows), 5))
    held = [(i, [max(min(math.floor(256 * f32(c)), 2**63 - 1), -(2**63)) for c in v]) for i, v in rows]
    assert got == plain_top(held, held, 5, scale=1) and len(got) == 12
    none = table(spark, [])
    assert topk.search(none, none).count() == 0 and topk.search(table(spark, rows), none).count() == 0
    alone = table(spark, rows[:1])
    assert topk.search(alone, alone).count() == 0


def test_counts_and_eigenvectors():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 40):
        a = r.standard_normal((n, n))
        a = a + a.T
        w = np.linalg.eigvalsh(a)
        for shift in (*r.uniform(w[0] - 1, w[-1] + 1, 20), 0.0):
            assert whitening.count_above(a, shift) == int((w > shift).sum())
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0) == 1 and whitening.count_above(np.zeros((3, 3)), 0) == 0
    q = np.linalg.qr(r.standard_normal((30, 30)))[0]
    for values in (np.arange(1, 31.0), np.repeat([5.0, 2.0, 1.0], 10), np.r_[1 + 1e-9 * np.arange(10), np.ones(20) / 7], np.r_[1e6, np.logspace(0, -8, 29)], np.ones(30)):
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        e, v = whitening.leading(a, 30)
        w = np.linalg.eigvalsh(a)[::-1][: len(e)]
        assert len(e) == int((np.sort(values)[::-1] > 1e-10 * values.max()).sum())
        assert np.allclose(e, w, rtol=1e-9, atol=1e-12 * w[0]) and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-10
        assert np.abs(a @ v - v * e).max() < 1e-12 * w[0] * 30


def plain_whitening(rows, top):
    width = max((len(v) for _, v in rows), default=0)
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = (x - np.array([int(t) / n for t in s])).astype(float)
    cov = d.T @ d / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    return ((n * x - s) ** 2).sum(axis=1).tolist(), d @ v / np.sqrt(e), e / cov.trace()


def test_whitening_against_eigh(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in data.collect()]
    deviation, y, explained = plain_whitening(rows, 32)
    got = {}
    for r in whitening.whiten(data).collect():
        got[r["vec_id"], r["component"]] = r
    assert len(got) == 32 * len(rows) and dict(whitening.whiten(data).dtypes)["component"] == "int"
    for c in range(1, 33):
        a = np.array([got[i, c]["whitened"] for i, _ in rows])
        assert min(np.abs(a - y[:, c - 1]).max(), np.abs(a + y[:, c - 1]).max()) < 1e-6
        assert abs(got[rows[0][0], c]["explained"] - explained[c - 1]) < 1e-9
    assert [got[i, 1]["deviation"] for i, _ in rows] == deviation
    assert {r["n"] for r in got.values()} == {len(rows)} and len({r["identity_error"] for r in got.values()}) == 1
    assert got[rows[0][0], 1]["identity_error"] < 1e-9


def test_whitening_of_edges(spark):
    r = random.Random(3)
    rows = [(k, [f32(r.gauss(0, 1)) for _ in range(3)]) for k in range(30)] + [(None, [0.5, 0.25, 0.0])] + [(99, [0.5, 0.5, 0.5])] * 3 + [(100, [0.5]), (101, [])]
    bad = [(200, None), (201, [1.0, None, 1.0]), (202, [math.nan] * 3), (203, [math.inf, 0.0, 0.0])]
    got = whitening.whiten(table(spark, rows + bad)).collect()
    deviation, y, explained = plain_whitening(rows, 3)
    assert len(got) == 3 * len(rows) and {g["component"] for g in got} == {1, 2, 3}
    assert Counter((g["vec_id"], g["deviation"]) for g in got if g["component"] == 1) == Counter((i, d) for (i, _), d in zip(rows, deviation))
    assert max(g["identity_error"] for g in got) < 1e-9 and got[0]["n"] == len(rows)
    flat = [(k, [float(k), 2.0 * k, 1.0]) for k in range(5)]  # one direction only
    assert {g["component"] for g in whitening.whiten(table(spark, flat)).collect()} == {1}
    for none in ([], bad, [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(4)], [(1, [])]):
        assert whitening.whiten(table(spark, none)).count() == 0
    huge = whitening.whiten(table(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert huge and all(g["deviation"] is None for g in huge if g["vec_id"] < 3)


def plain_draw(docs, bench, most=1, least=20, percent=10, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, most + 1) for k in range(len(w) - n + 1)]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in bench for b in features(x)[1])
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda x: math.floor(1000 * math.log((t[x] + 1.0) * a / ((s[x] + 1.0) * b)))
    out = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-x[4], x[0] is None, x[0] or 0, x[2], k) for k, x in enumerate(out) if x[1] >= least)
    rank = {x[-1]: r for r, x in enumerate(able[: percent * len(able) // 100], 1)}
    return Counter((x[0], *x[2:], rank.get(k)) for k, x in enumerate(out))


DOCS = "doc_id long, text string, score int, rank int, key int, row int, bucket int"


def drawn(spark, docs, bench, **more):
    d = spark.createDataFrame([(*x, 7, 7, 7, 7, 7) for x in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(t, 7) for t in bench], "text string, n int")
    got = importance.resample(d, b, **more)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("most, percent", [(1, 10), (2, 50), (1, 100), (1, 0)])
def test_draw_against_plain(spark, most, percent):
    r = random.Random(most)
    words = ["tree", "House", "été", "日本語", "a1b2", "x" * 60, "word", "of"]
    text = lambda n: "".join(r.choice(words) + r.choice([" ", ", ", "\n", "/", "\x00"]) for _ in range(n))
    docs = [(k, text(r.randrange(0, 60))) for k in range(300)] + [(400 + k, None) for k in range(3)] + [(500, ""), (None, text(30)), (None, text(31))]
    docs += [(600, text(40))] * 40 + [(700, text(40))] * 2 + [(800, " ".join(words) * 20_000)]
    bench = [text(50), None, ""]
    assert drawn(spark, docs, bench, most=most, percent=percent) == plain_draw(docs, bench, most, percent=percent)


def test_draw_of_nothing(spark):
    assert drawn(spark, [], ["a b"]) == Counter() == drawn(spark, [], [])
    few = [(1, "one two"), (2, None)]
    assert drawn(spark, few, []) == plain_draw(few, [])


def test_kth_key_of_many_copies(spark):
    r = random.Random(4)
    values = [r.randrange(1000) for _ in range(2000)] + [500] * 1500
    df = spark.createDataFrame([(v,) for v in values], "key long").repartition(4)
    order = sorted(values)
    for k in (1, 2, 999, 1700, 2600, 3500):
        assert importance.kth_key(df, "key", k, pivots=7) == order[k - 1]
    with pytest.raises(ValueError):
        importance.kth_key(df, "key", 3501)


def test_crc_of_ranges():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts, ends = np.array([0, 5, 5, 100, 700]), np.array([0, 6, 60, 600, 768])
    assert importance.crc32_of(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert importance.crc32_of(data, starts[:0], ends[:0]).tolist() == []


def test_noise_is_a_gumbel_draw(spark):
    got = [r[0] for r in spark.range(2000).withColumnRenamed("id", "doc_id").select(importance.noise()).collect()]
    assert abs(np.mean(got) - 577) < 100 and abs(np.std(got) - 1283) < 120


def test_registered_queries(spark):
    from loomgrid.llm.queries import QUERIES

    assert QUERIES["op11_maxscore_topk"](spark, SF).agg(F.count_distinct("query_id"), F.max("rank")).first() == (10, 5)
    assert QUERIES["op13_importance_resampling"](spark, SF).filter("rank IS NOT NULL").count() > 0
