"""Language identification with a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window and
classed by softmax. The network is trained here, in numpy, on windows of a bounded, hashed sample
of labelled texts, the same number for each language. A text is covered by fixed-length windows
from its first byte to its last; their probabilities are averaged.

A convolution of embedded bytes is a sum of table rows (one table of 256 rows per offset), so
prediction is gathering, adding and a maximum, in batches of windows.

Cases: a null text, or one without a letter, is ``und`` with score 0; where nothing is labelled,
every text is; labels that are null are not learned from; repeated rows are predicted alike; of tied languages
the first by name is taken; an empty table gives an empty result; a text shorter than a window is padded with zero bytes, a very
long one has as many windows as it needs; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, is_held_out, lut, text_chunks

#: Bytes of a window; texts sampled for each language and windows of each text; texts sampled in all.
WINDOW, TEXTS, PER_TEXT, MOST_TEXTS = 192, 700, 4, 50_000
#: The network: embedding, filter widths, filters of each width.
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 12
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.01, 5
#: Windows that are predicted at once.
AT_ONCE = 512

_ASCII_LETTER = lut((65, 90), (97, 122))


class Network(NamedTuple):
    """The languages, and per width the tables (width, 256, filters), biases; the output weights and biases."""

    languages: list[str]
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray


def sample_windows(texts: DataFrame, per_language: int = TEXTS) -> tuple[np.ndarray, list[str]]:
    """Windows (n x WINDOW bytes) and their languages, from at most ``per_language`` texts of each language.

    Texts are chosen by a digest of id and text, with a threshold from the language's count of distinct digests; rows that are equal in
    both count and come once. So rows that share an id, or have none, are drawn one by one. All languages are
    learned; where they are many, each gives fewer texts, so that the sample has about MOST_TEXTS x PER_TEXT windows
    at most (or one text of each language).
    """
    known = texts.filter("lang IS NOT NULL AND text IS NOT NULL")
    digest = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(SEED)), F.lit(1 << 46))
    known = known.withColumn("digest", digest)
    counts = {r["lang"]: r["n"] for r in known.select("lang", "digest").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return np.empty((0, WINDOW), np.uint8), []
    per_language = max(1, min(per_language, MOST_TEXTS // len(counts)))
    place = F.col("digest").cast("double") / float(1 << 46)
    share = known.sparkSession.createDataFrame([(k, min(1.0, per_language / n), n <= per_language) for k, n in counts.items()], "_lang string, _share double, _all boolean")
    # of a language that gives one text, the digest might choose none: its first by digest is always in
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place")) if per_language == 1 else F.lit(2)
    chosen = known.withColumn("place", place).join(F.broadcast(share), F.col("lang") == F.col("_lang")).withColumn("first", first).filter((F.col("place") < F.col("_share")) | F.col("_all") | (F.col("first") == 1)).dropDuplicates(["lang", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, cut = [], []
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                raw = text.as_py().encode()
                spots = np.unique(np.linspace(0, max(0, len(raw) - WINDOW), PER_TEXT).astype(int))
                for a in spots:
                    cut.append(raw[a : a + WINDOW])
                    langs.append(lang.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], names=["lang", "cut"])

    got = chosen.select("lang", "text").mapInArrow(run, "lang string, cut binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["cut"])))  # the same training in every run
    data = np.zeros((len(got), WINDOW), dtype=np.uint8)
    for k, r in enumerate(got):
        raw = np.frombuffer(bytes(r["cut"]), np.uint8)
        data[k, : len(raw)] = LOWER[raw]
    return data, [r["lang"] for r in got]


def _forward(x: np.ndarray, tables: list[np.ndarray], biases: list[np.ndarray], places: bool = False) -> tuple:
    """Pooled activations (n x all filters), and where each maximum stands."""
    pooled, at = [], []
    for table, bias in zip(tables, biases, strict=True):
        w = len(table)
        y = table[0][x[:, : x.shape[1] - w + 1]]
        for o in range(1, w):
            y += table[o][x[:, o : x.shape[1] - w + 1 + o]]
        if places:
            at.append(y.argmax(axis=1))
        pooled.append(y.max(axis=1) + bias)
    return np.maximum(np.concatenate(pooled, axis=1), 0), at


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(data: np.ndarray, labels: list[str], epochs: int = EPOCHS) -> Network | None:
    """The network by Adam on cross-entropy; gradients pass through the places of the maxima."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    y = np.searchsorted(languages, labels)
    share = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))  # rare languages weigh as much
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "v": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "c": np.zeros(len(languages))}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, 0.3, (w, EMBED, FILTERS)), np.zeros(FILTERS)
    p = {k: a.astype(np.float32) for k, a in p.items()}
    m, s, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order[i : i + BATCH]
            x, target = data[pick], y[pick]
            tables = [np.einsum("be,oef->obf", p["e"], p[f"f{w}"]) for w in WIDTHS]
            h, at = _forward(x, tables, [p[f"b{w}"] for w in WIDTHS], places=True)
            d = _softmax(h @ p["v"] + p["c"])
            d[np.arange(len(pick)), target] -= 1
            d *= (share[target] / len(pick))[:, None].astype(np.float32)
            g = {"v": h.T @ d, "c": d.sum(axis=0), "e": np.zeros_like(p["e"])}
            dh = (d @ p["v"].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                part = dh[:, k * FILTERS : (k + 1) * FILTERS]
                g[f"b{w}"], gf = part.sum(axis=0), np.zeros_like(p[f"f{w}"])
                for o in range(w):
                    byte = x[np.arange(len(x))[:, None], at[k] + o]  # the byte under each maximum
                    emb = p["e"][byte]
                    gf[o] = np.einsum("nfe,nf->ef", emb, part)
                    np.add.at(g["e"], byte.ravel(), (part[:, :, None] * p[f"f{w}"][o].T[None]).reshape(-1, EMBED))
                g[f"f{w}"] = gf
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    tables = [np.einsum("be,oef->obf", p["e"], p[f"f{w}"]).astype(np.float32) for w in WIDTHS]
    return Network(languages, tables, [p[f"b{w}"] for w in WIDTHS], p["v"], p["c"])


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover each row from end to end (the last one ends with the row), as begins and rows."""
    size = np.diff(offs)
    n = np.maximum(1, -(-size // WINDOW))
    rows = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.minimum(k * WINDOW, np.maximum(size[rows] - WINDOW, 0)) + offs[rows]
    return begin, rows


def classify(data: np.ndarray, offs: np.ndarray, net: Network) -> np.ndarray:
    """Mean probabilities (rows x languages)."""
    docs = len(offs) - 1
    begin, rows = windows_of(data, offs)
    low = np.concatenate([LOWER[data], np.zeros(WINDOW, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(low, WINDOW)
    size = np.diff(offs)
    total = np.zeros((docs, len(net.languages)))
    for i in range(0, len(begin), AT_ONCE):
        x, r = view[begin[i : i + AT_ONCE]], rows[i : i + AT_ONCE]
        if (short := size[r] < WINDOW).any():
            x = np.where(short[:, None] & (np.arange(WINDOW) >= size[r][:, None]), 0, x)
        h, _ = _forward(x, net.tables, net.biases)
        np.add.at(total, r, _softmax(h @ net.weights + net.bias))
    return total / np.bincount(rows, minlength=docs)[:, None]


def has_letter(texts: pa.Array, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which rows hold a letter; those without an ASCII letter are looked at character by character."""
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = total[offs[1:]] > total[offs[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in texts[int(k)].as_py() or "")
    return out


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offs in text_chunks(batch.column("text")):
                known = has_letter(batch.column("text").slice(a, b - a), data, offs) & (net is not None)
                names, score = np.full(b - a, "und", dtype=object), np.zeros(b - a)
                if known.any():
                    p = classify(data, offs, net)
                    names = np.where(known, np.array(net.languages, dtype=object)[p.argmax(axis=1)], "und")
                    score = np.where(known, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, held_out: Column | None = None, per_language: int = TEXTS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the labelled ones that aren't held out."""
    out = is_held_out() if held_out is None else held_out
    net = train(*sample_windows(docs.filter(~out).select("doc_id", "text", "lang"), per_language))
    return predict(docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")
