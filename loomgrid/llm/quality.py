"""Quality rules and distribution divergence.

Base rules look at counts of words, symbols, repeated lines and repeated three-word windows.
The verdict compares each document with language references that are summed over the whole
corpus: a histogram of character classes and one of common words (of any length), by Jensen-Shannon
distance to the nearest language. Both need a least length, below which they don't judge.
As a text without any common word is the nearer to a language the rarer those are, the distance
of words is taken relative to that of such a text; a language without common words (no spaces)
holds what is near by classes.

A language is a reference if enough documents and words have it; where none has, all languages
count, and where there is none, the documents without a language. Languages that aren't references
are judged by the others.

Cases: a null or empty text has no words and fails the base rules; a null language is no reference
beside others; words that tie for the last place among the common ones are all left out; repeated rows are
judged alike; an empty table gives an empty result; a very long text is worked on whole, in its own chunk;
``keep_good`` keeps all columns, whatever their names, and ``judge_quality`` returns only the named ones that no
result is named like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE_SEPARATED, by_row_and_value, columns_of, fresh, hashes, row_of, runs, staged, text_chunks

#: Base rules: least words; most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Most Jensen-Shannon distance (0 to 1) of classes to the nearest reference, and words below which the histogram doesn't judge.
MOST_CLASS_DISTANCE, LEAST_WORDS_CLASSES = 0.22, 20
#: Most distance of common words, as a share of that of a text without any, and words below which the histogram doesn't judge.
MOST_WORD_DISTANCE, LEAST_WORDS_COMMON = 0.95, 80
#: Documents with words, and words, that make a language a reference; share of all words that its common ones need.
LEAST_DOCS, LEAST_TEXT, LEAST_MASS = 10, 1000, 0.1
#: Common words of a language: at most so many, and each at least one in so many of all words.
COMMON, RAREST = 40, 2000

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Character classes: lower, upper, digit, sentence marks, other ASCII marks, white space, lead bytes beyond ASCII.
CLASSES = 7
_CLASS = np.full(256, 4, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[0xC0:] = 0, 1, 2, 6
for _c in b".,;:'\"?()-":
    _CLASS[_c] = 3
for _c in b" \t\n\r\v\f":
    _CLASS[_c] = 5
_CLASS[0x80:0xC0] = 255  # continuation bytes aren't characters


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def class_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Characters of each class in each row."""
    kinds = _CLASS[data]
    return np.stack([_sums(kinds == k, offs) for k in range(CLASSES)], axis=1)


def repeated(keys: np.ndarray, rows: np.ndarray, stable: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """True where a key comes twice or more in its row; and (if ``stable``) where it came earlier in its row."""
    order = by_row_and_value(keys, rows, stable)
    k, r = keys[order], rows[order]
    same = np.zeros(len(k), dtype=bool)
    same[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    again = np.zeros(len(k), dtype=bool)
    again[order] = same
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(k), dtype=bool)
    out[order] = twice
    return out, again


def base_counts(data: np.ndarray, offs: np.ndarray, words: tuple) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    starts, ends, wofs = words
    docs = len(offs) - 1
    inside = SPACE_SEPARATED[data]
    lead = (data & 0xC0) != 0x80
    rows = row_of(wofs)
    h = hashes(data, starts, ends)
    # windows of three words within a row
    covered = np.zeros(len(h), dtype=bool)
    if len(h) > 2:
        win = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        ok = np.flatnonzero(rows[2:] == rows[:-2])
        hit = ok[repeated(win[ok], rows[ok])[0]] if len(ok) else ok
        for k in range(3):
            covered[hit + k] = True
    # lines with a word; equal to an earlier line of the row
    ls, le, lofs = runs(data != 10, offs)
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    lrows = row_of(lofs)[has_word]
    dup = repeated(hashes(data, ls[has_word], le[has_word]), lrows, stable=True)[1] if len(lrows) else np.zeros(0, bool)
    return {
        "n_words": np.diff(wofs),
        "word_chars": _sums(inside & lead, offs),
        "n_symbols": _sums(_SYMBOLS[data], offs),
        "n_dup_lines": np.bincount(lrows[dup], minlength=docs),
        "n_repeat_words": np.bincount(rows[covered], minlength=docs),
    }


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Chunks: bytes, offsets, words; each row's language as a number, and the languages (the last is null)."""
    for batch in batches:
        coded = batch.column("lang").cast(pa.string()).dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None]
        lang = coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
        for a, b, data, offs in text_chunks(batch.column("text")):
            yield data, offs, runs(SPACE_SEPARATED[data], offs), lang[a:b], names


def _reference_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums for the references: (lang, kind, item, n); kind 0: character class, 1: word (its hash), 2: all words, 3: documents with words.

    Of a chunk's words only those with half of a common word's share are sent on.
    """
    for data, offs, (starts, ends, wofs), of, names in _by_language(batches):
        n_words = np.diff(wofs)
        classes = class_counts(data, offs)
        h = hashes(LOWER[data], starts, ends).view(np.int64)
        at = of[row_of(wofs)]
        for k in np.unique(of):
            item, n = np.unique(h[at == k], return_counts=True)
            often = 2 * RAREST * n >= n.sum()
            item, n = item[often], n[often]
            items = np.concatenate([np.arange(CLASSES), item, [0, 0]])
            kinds = np.concatenate([np.zeros(CLASSES), np.ones(len(item)), [2, 3]])
            counts = np.concatenate([classes[of == k].sum(axis=0), n, [n_words[of == k].sum(), (n_words[of == k] > 0).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(items), pa.string()), pa.array(kinds.astype(np.int32)), pa.array(items.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "kind", "item", "n"])


def _counts_of(known: dict[str | None, np.ndarray]):
    """Partial counts of the given words: (lang, item, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, _, (starts, ends, wofs), of, names in _by_language(batches):
            h = hashes(LOWER[data], starts, ends).view(np.int64)
            at = of[row_of(wofs)]
            for k in np.unique(of):
                words = known.get(names[k])
                if words is None or not len(words):
                    continue
                mine = h[at == k]
                place = np.minimum(np.searchsorted(words, mine), len(words) - 1)
                n = np.bincount(place[words[place] == mine], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(words), pa.string()), pa.array(words), pa.array(n.astype(np.int64))], names=["lang", "item", "n"])

    return run


def language_references(docs: DataFrame) -> dict[str | None, dict]:
    """Per reference language its class histogram, all words, and the most frequent words, over the whole corpus.

    The common words are those of the first COMMON places that are one in RAREST of all words at least; where
    words tie across the last place none of these is one. A word's occurrences that the first pass leaves out
    are less than half of that share in their chunks, so what it gives of a common word is at least half of the share
    of all words. That leaves at most 2 * RAREST words of a language, which the second pass counts: a bounded list, and
    little to shuffle.
    """
    texts = docs.select("lang", "text")
    sums = staged(texts.mapInArrow(_reference_rows, "lang string, kind int, item long, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "references")
    out: dict[str | None, dict] = {}
    for r in sums.filter("kind <> 1").collect():
        ref = out.setdefault(r["lang"], {"classes": np.zeros(CLASSES), "words": {}, "all": 0, "docs": 0})
        if r["kind"] == 0:
            ref["classes"][r["item"]] = r["n"]
        else:
            ref["all" if r["kind"] == 2 else "docs"] = r["n"]
    level = {k: 0 if k is None else 2 if ref["docs"] >= LEAST_DOCS and ref["all"] >= LEAST_TEXT else 1 for k, ref in out.items() if ref["all"]}
    out = {k: out[k] for k in level if level[k] == max(level.values())}
    size = sums.filter("kind = 2").select(F.col("lang").alias("_lang"), F.col("n").alias("all"))
    likely = sums.filter("kind = 1").join(F.broadcast(size), F.col("lang").eqNullSafe(F.col("_lang"))).filter(2 * RAREST * F.col("n") >= F.col("all"))
    known: dict[str | None, list[int]] = {}
    for r in likely.select("lang", "item").collect():
        if r["lang"] in out:
            known.setdefault(r["lang"], []).append(r["item"])
    words = {k: np.array(sorted(v), dtype=np.int64) for k, v in known.items()}
    for r in texts.mapInArrow(_counts_of(words), "lang string, item long, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")).collect():
        if RAREST * r["n"] >= out[r["lang"]]["all"]:
            out[r["lang"]]["words"][r["item"]] = r["n"]
    for ref in out.values():
        if len(ref["words"]) > COMMON:
            least = sorted(ref["words"].values())[-COMMON - 1]
            ref["words"] = {k: n for k, n in ref["words"].items() if n > least}
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence to base 2) of the rows of p to q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=1)
        return np.sqrt(np.clip((kl(p) + kl(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def distances(data: np.ndarray, offs: np.ndarray, words: tuple, refs: dict[str | None, dict], most_class: float = MOST_CLASS_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distance to the nearest language: of character classes, and of common words (one more bin for all others) as a share of that of a text without any."""
    docs = len(offs) - 1
    classes = class_counts(data, offs).astype(float)
    classes /= np.maximum(classes.sum(axis=1, keepdims=True), 1)
    n_words = np.diff(words[2])
    every = np.unique(np.array([w for ref in refs.values() for w in ref["words"]], dtype=np.int64))
    counts = np.zeros((docs, len(every)))
    if len(every):
        h = hashes(LOWER[data], words[0], words[1]).view(np.int64)
        at = np.minimum(np.searchsorted(every, h), len(every) - 1)
        ok = np.flatnonzero(every[at] == h)
        counts = np.bincount(row_of(words[2])[ok] * len(every) + at[ok], minlength=docs * len(every)).reshape(docs, -1) / np.maximum(n_words, 1)[:, None]
    by_class, by_word = np.ones(docs), np.ones(docs)
    for ref in refs.values():
        of_class = js_distance(classes, ref["classes"] / max(ref["classes"].sum(), 1))
        by_class = np.minimum(by_class, of_class)
        mine = np.array(sorted(ref["words"]), dtype=np.int64)
        q = np.array([ref["words"][k] for k in mine.tolist()]) / ref["all"]
        if q.sum() < LEAST_MASS:
            by_word = np.where(of_class <= most_class, 0.0, by_word)
            continue
        p = counts[:, np.searchsorted(every, mine)]
        p, q = np.concatenate([p, 1 - p.sum(axis=1, keepdims=True)], axis=1), np.append(q, 1 - q.sum())
        none = np.zeros((1, len(q)))
        none[0, -1] = 1
        by_word = np.minimum(by_word, js_distance(p, q) / js_distance(none, q)[0])
    return by_class, by_word


VERDICT = pa.struct(
    [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [(n, pa.float64()) for n in ("class_distance", "word_distance")] + [(n, pa.bool_()) for n in ("base_failed", "kept")]
)
SCHEMA = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, class_distance: double, word_distance: double, base_failed: boolean, kept: boolean>"


def judge_chunk(data: np.ndarray, offs: np.ndarray, refs: dict[str | None, dict], most_class: float = MOST_CLASS_DISTANCE, most_word: float = MOST_WORD_DISTANCE) -> dict[str, np.ndarray]:
    words = runs(SPACE_SEPARATED[data], offs)
    out = base_counts(data, offs, words)
    out["class_distance"], out["word_distance"] = distances(data, offs, words, refs, most_class)
    n = out["n_words"]
    out["base_failed"] = (n < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * n)
    odd = (n >= LEAST_WORDS_CLASSES) & (out["class_distance"] > most_class) | (n >= LEAST_WORDS_COMMON) & (out["word_distance"] > most_word)
    out["kept"] = ~out["base_failed"] & ~(odd & bool(refs))
    return out


def verdict(refs: dict[str | None, dict], **limits: float) -> Column:
    """The verdict on the column ``text``: only texts go to Python, only the verdicts come back."""

    def judge(text: pa.Array) -> pa.Array:
        done = [pa.StructArray.from_arrays([pa.array(v).cast(f.type) for v, f in zip(judge_chunk(data, offs, refs, **limits).values(), VERDICT, strict=True)], fields=list(VERDICT)) for _, _, data, offs in text_chunks(text)]
        return pa.concat_arrays(done) if done else pa.array([], VERDICT)

    # non-deterministic: Spark would run it again for a filter above
    return F.arrow_udf(judge, SCHEMA).asNondeterministic()(F.col("text"))


def judge_quality(docs: DataFrame, refs: dict[str | None, dict] | None = None, keep: tuple[str, ...] = ("doc_id",), **limits: float) -> DataFrame:
    """The columns ``keep`` of every document with its counts, distances and verdict; references come from ``docs`` where none are given."""
    refs = language_references(docs) if refs is None else refs
    v = fresh(docs, "_verdict")
    names = [f.name for f in VERDICT]
    keep = tuple(c for c in keep if c.lower() not in names)
    return docs.select(*keep, verdict(refs, **limits).alias(v)).select(*keep, *[F.col(v)[n].alias(n) for n in names])


def keep_good(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    v = fresh(docs, "_verdict")
    return docs.select(*columns_of(docs), verdict(language_references(docs), **limits).alias(v)).filter(F.col(v)["kept"]).select(*columns_of(docs))
