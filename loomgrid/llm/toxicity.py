"""Toxicity by weak supervision.

1. Voters: words and word beginnings (4 to 8 bytes), once or several times, that the labelled sample
   ties to toxic texts make a lexicon; each entry votes if a text has it so often. Pattern voters look at how many entries, how
   dense and how varied, and at marks (shouting, exclamations).
2. A generative label model estimates, by expectation maximisation, each voter's rate of voting in
   toxic and in other texts (its accuracy) and the voters' correlations within the classes (a
   pooled covariance), and gives each sampled text a posterior. It sees votes only: it starts from the
   odds of each text's strongest voter, and patterns that just restate one lexicon entry have no vote.
3. A linear (logistic) classifier is trained on the posteriors over lexicon and pattern features,
   and scores every whole text. A text counts by how far its label and posterior agree.

The sample is bounded (``SAMPLE_ROWS`` ids by their digest, one text an id); the lexicon's counts are summed in
Spark. Labels of held-out rows, and lang, source and doc_id, are never used for a score.

Cases: a null or empty text is scored from no features, with a low score; where nothing is labelled
toxic every score is 0; null labels are skipped; several labels of a document count as toxic if any
does; of texts that share an id one is learned (the least digest); repeated rows score alike; entries that tie for the lexicon's last place go by their hash; a very long text is scored whole, in its own
chunk; an empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, by_row_and_value, hashes, is_held_out, lut, mix, row_of, runs, staged, text_chunks

SAMPLE_ROWS, VOTERS, LEAST_TEXTS, THRESHOLD = 20_000, 160, 3, 0.3
#: An entry's share of the toxic texts must be so many times its share of the others; nats beyond chance.
LEAST_LIFT, CHANCE = 20, 3.0
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of a text whose label and posterior disagree wholly.
LEAST_WEIGHT = 0.02
#: An entry asks for so many occurrences at least.
TIMES = (1, 2, 4)
#: Bytes of words here: letters, digits, all beyond ASCII.
WORD_BYTES = lut((48, 57), (65, 90), (97, 122), (0x80, 0xFF))
_UPPER, _BANG = lut((65, 90)), lut((33, 33))
PATTERNS = 8
#: The first patterns are thresholds of the strongest entry and of two entries: features of the classifier, no voters.
RESTATED = 4


def features_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each row's words and word beginnings with their rows; words per row; bytes per row that are capitals or '!'."""
    low = LOWER[data]
    starts, ends, wofs = runs(WORD_BYTES[low], offs)
    rows = row_of(wofs)
    keys, owner = [hashes(low, starts, ends)], [rows]
    for n in PREFIXES:
        longer = ends - starts > n
        s = starts[longer]
        keys.append(hashes(low, s, s + n) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        owner.append(rows[longer])
    total = lambda t: (c := np.concatenate([[0], np.cumsum(t[data])]))[offs[1:]] - c[offs[:-1]]
    return np.concatenate(keys), np.concatenate(owner), np.diff(wofs), np.stack([total(_UPPER), total(_BANG)], axis=1)


def entry(keys: np.ndarray, times: int) -> np.ndarray:
    """The number of "this feature, so many times or more"."""
    return mix(keys + np.uint64(times))


def entries_of(keys: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's entries (feature and least count), and their offsets."""
    order = by_row_and_value(keys, row_of(offs))
    k, r = keys[order], row_of(offs)[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(k)))
    v = np.concatenate([entry(k[first[n >= t]], t) for t in TIMES])
    rows = np.concatenate([r[first[n >= t]] for t in TIMES])
    order = np.argsort(rows, kind="stable")
    return v[order], np.searchsorted(rows[order], np.arange(len(offs)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, other): partial sums of the texts that have each feature."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, data, offs in text_chunks(batch.column("text")):
            keys, rows, _, _ = features_of(data, offs)
            order = np.argsort(rows, kind="stable")
            v, vofs = entries_of(keys[order], np.searchsorted(rows[order], np.arange(b - a + 1)))
            f, at = np.unique(v, return_inverse=True)
            is_toxic = toxic[a:b][row_of(vofs)]
            pos = np.bincount(at, weights=is_toxic, minlength=len(f)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(f)) - pos)], names=["feature", "toxic", "other"])


def mine_lexicon(sample: DataFrame, n_toxic: int, n_other: int, voters: int = VOTERS) -> tuple[np.ndarray, np.ndarray]:
    """The features with the largest log-likelihood ratio towards toxic texts (sorted hashes), and a low bound of each one's log-odds."""
    sums = sample.select("text", "toxic").mapInArrow(_count, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).filter(F.col("t") >= LEAST_TEXTS)
    sums = staged(sums, "features")
    share, both = n_toxic / (n_toxic + n_other), F.col("t") + F.col("o")
    # log-likelihood ratio against the sample's share of toxic texts, beyond what as many entries reach by chance
    part = lambda n, rest: F.when(n > 0, n * F.log(n / (both * rest))).otherwise(F.lit(0.0))
    gain = part(F.col("t"), share) + part(F.col("o"), max(1 - share, 1e-9))
    least = float(np.log(max(sums.count(), 1)) + CHANCE)
    lift = sums.withColumn("gain", gain).filter((F.col("gain") >= least) & (F.col("t") / n_toxic > LEAST_LIFT * F.col("o") / max(n_other, 1)))
    # ties go by the hash
    got = lift.orderBy(F.desc("gain"), "feature").limit(voters).collect()
    keys = np.array([r["feature"] for r in got], dtype=np.int64).view(np.uint64)
    t, o = (np.array([r[c] for r in got], dtype=float) + 0.5 for c in ("t", "o"))
    order = np.argsort(keys)
    return keys[order], (np.log(t / o) - np.sqrt(1 / t + 1 / o) / 2)[order]


def vote_matrix(data: np.ndarray, offs: np.ndarray, lexicon: np.ndarray, strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hits of each lexicon entry (rows x entries) and pattern features (rows x PATTERNS)."""
    keys, rows, n_words, marks = features_of(data, offs)
    docs, total = len(offs) - 1, np.zeros(len(offs) - 1)
    hit = np.zeros((docs, len(lexicon)), dtype=bool)
    if len(lexicon) and len(keys):
        for k, t in enumerate(TIMES):
            e = entry(keys, t)
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[(lexicon & np.uint64(0xFFFF)).astype(np.int64)] = True
            near = np.flatnonzero(maybe[(e & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(lexicon, e[near]), len(lexicon) - 1)
            ok = lexicon[at] == e[near]
            count = np.bincount(rows[near[ok]] * len(lexicon) + at[ok], minlength=docs * len(lexicon)).reshape(docs, -1)
            hit |= count >= t
            if k == 0:
                total = count.sum(axis=1)
    words, size, kinds = np.maximum(n_words, 1), np.maximum(np.diff(offs), 1), hit.sum(axis=1)
    best = np.maximum((np.where(hit, strength, -9.0)).max(axis=1, initial=-9.0), 0)
    patterns = np.stack([best, best > 1, best > 2, kinds > 1, kinds > 3, np.minimum(total / words * 10, 1), marks[:, 0] / size > 0.5, marks[:, 1] / size > 0.02], axis=1).astype(float)
    return hit.astype(float), patterns


class LabelModel(NamedTuple):
    """Class means of the votes (2 x voters), pooled covariance and the share of toxic texts."""

    means: np.ndarray
    covariance: np.ndarray
    prior: float


def first_guess(hit: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Odds of each text's strongest voter, as probabilities; low ones where no entry votes."""
    best = np.where(hit > 0, strength, -9.0).max(axis=1, initial=-9.0)
    return np.clip(1 / (1 + np.exp(-best)), 0.02, 0.98)


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50) -> tuple[LabelModel, np.ndarray]:
    """Expectation maximisation from the votes alone, from the given probabilities; returns the posteriors, too."""
    post = start
    for _ in range(rounds):
        w1, w0 = post.sum(), (1 - post).sum()
        means = np.stack([((1 - post)[:, None] * votes).sum(axis=0) / w0, (post[:, None] * votes).sum(axis=0) / w1])
        residual = votes - (1 - post)[:, None] * means[0] - post[:, None] * means[1]
        cov = residual.T @ residual / len(votes)
        cov = 0.8 * cov + 0.2 * np.diag(np.diag(cov)) + 1e-3 * np.eye(votes.shape[1])  # shrunk
        weights = np.linalg.solve(cov, means[1] - means[0])
        prior = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
        logit = (votes - means.mean(axis=0)) @ weights + np.log(prior / (1 - prior))
        new = np.clip(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 1e-4, 1 - 1e-4)
        done, post = np.abs(new - post).max() < 1e-4, new
        if done:
            break
    return LabelModel(means, cov, prior), post


def fit_linear(x: np.ndarray, target: np.ndarray, count: np.ndarray, rounds: int = 60, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression on soft targets, each row counting so much, by Newton steps; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penal = np.full(x.shape[1], ridge)
    penal[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + np.diag(penal), x.T @ (count * (p - target)) + penal * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model(NamedTuple):
    lexicon: np.ndarray
    strength: np.ndarray
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The classifier, or None where no toxic text is labelled."""
    out = is_held_out() if held_out is None else held_out
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), "doc_id").limit(sample_rows)
    # one text an id, so that the sample is bounded where ids repeat
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    sample = staged(texts, "labelled")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return None
    lexicon, strength = mine_lexicon(sample, n[1], n.get(0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text")):
                hit, patterns = vote_matrix(data, offs, lexicon, strength)
                rows = np.concatenate([hit, patterns], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("toxic").slice(a, b - a), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "toxic", "votes"])

    kind = dict(sample.dtypes)["doc_id"]
    got = sample.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {kind}, toxic int, votes binary").collect()  # sample_rows x voters numbers
    got.sort(key=lambda r: r["doc_id"])
    x = np.stack([np.frombuffer(bytes(r["votes"]), np.float32) for r in got]).astype(float)
    gold = np.array([r["toxic"] for r in got], dtype=float)
    hit, patterns = x[:, : len(lexicon)], x[:, len(lexicon) :]
    _, posterior = fit_label_model(np.concatenate([hit, patterns[:, RESTATED:]], axis=1), first_guess(hit, strength))
    agreed = np.clip(posterior * gold + (1 - posterior) * (1 - gold), LEAST_WEIGHT, 1)
    return Model(lexicon, strength, fit_linear(x, posterior, agreed))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text")):
                p = np.zeros(b - a)
                if model is not None:
                    x = np.concatenate(vote_matrix(data, offs, model.lexicon, model.strength), axis=1)
                    p = 1 / (1 + np.exp(-np.clip(x @ model.weights[:-1] + model.weights[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(p)], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = is_held_out() if held_out is None else held_out
    return score(docs, learn(docs, labels, held_out)).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
