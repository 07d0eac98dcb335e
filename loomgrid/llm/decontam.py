"""Benchmark decontamination with an FM-index per shard of training text.

A task takes its documents in shards of bounded size. A shard's words become symbols: one per
benchmark word, one for a run of any other words, and an end mark per document. Their suffixes
are sorted, the Burrows-Wheeler transform goes into a wavelet matrix, and all windows of the
test items are searched backwards together. Occurrences are found by walking to sampled suffix
positions; the spans of a document are merged.

One Arrow function of the text does all of that, so only texts go to Python and only verdicts, and
the cut texts of contaminated documents, come back. The words of the benchmark are hashed by Spark
and come to the driver in blocks of at most ``BLOCK_WORDS`` words (or one item), one block at a time; the few blocks that
a benchmark beyond that has are one staged pass over the documents each. Documents aren't shuffled.

Cases: a null or empty text has no words and isn't contaminated; an empty benchmark finds
nothing; an item without words has no window, one of fewer words than a window is one window;
equal items are all reported; an item with a null id is searched and counted, but is not in the list of ids;
ids of any type are compared as strings; repeated rows are judged alike; ties can't arise; a very long text is
a shard of its own; columns beside ``text`` are kept as they are, whatever their names (``n_chars`` is corrected).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, columns_of, fresh, hashes, lut, row_of, runs, staged, text_chunks

WINDOW = 13
#: Contaminated: hit words of at least 1 / SHARE of all words.
SHARE = 20
#: Words of the benchmark in one block; bytes of text in one shard.
BLOCK_WORDS, SHARD_BYTES = 4_000_000, 2 << 20
#: Every so many text positions one suffix position is kept.
SAMPLE = 16
#: Bytes of words: digits, lower-case letters, all beyond ASCII (texts are lower-cased before).
WORD_BYTES = lut((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of all suffixes by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(symbols)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    # the first sort takes as many symbols as fit in 62 bits
    width = max(1, int(symbols.max()).bit_length()) if n else 1
    depth = max(1, 62 // (width + 1))
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(depth, np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(depth):
        key = (key << (width + 1)) | padded[k : k + n]
    active = np.argsort(key)
    key = key[active]
    old = np.zeros(n, dtype=np.int64)
    while len(active):
        at = np.arange(len(active))
        fresh = np.ones(len(active), dtype=bool)
        fresh[1:] = (key[1:] != key[:-1]) | (old[1:] != old[:-1])
        group = np.ones(len(active), dtype=bool)
        group[1:] = old[1:] != old[:-1]
        start = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[active] = old + start - np.maximum.accumulate(np.where(group, at, 0))
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        active = active[~alone]
        if not len(active):
            break
        old = rank[active]
        key = rank[np.minimum(active + depth, n)]
        both = np.argsort(old * np.int64(n + 1) + (key + 1))
        active, old, key = active[both], old[both], key[both]
        depth *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank[:n]] = np.arange(n)
    return out


class WaveletMatrix:
    """Ranks of symbols: how often a symbol stands in a prefix, for many symbols and prefixes at once."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = symbols
        for k in reversed(range(self.levels)):
            bit = (cur >> k) & 1
            up = np.zeros(len(cur) + 1, dtype=np.int32)
            np.cumsum(bit, out=up[1:])
            self.ones.append(up)
            self.zeros.append(len(cur) - int(up[-1]))
            on = bit.astype(bool)
            cur = np.concatenate([cur[~on], cur[on]])
        every = np.arange(sigma)
        self.begin = self._walk(every, np.zeros(sigma, dtype=np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, k in enumerate(reversed(range(self.levels))):
            up = self.ones[level][i]
            i = np.where((symbol >> k) & 1, self.zeros[level] + up, i - up)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(symbol, i) - self.begin[symbol]


class FMIndex:
    """Backward search and locating over symbols; symbol 0 ends a document and each of its places counts as different."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE) -> None:
        ends = symbols == 0
        # document ends are ordered by place, below all other symbols
        apart = symbols.astype(np.int64) + int(ends.sum())
        apart[ends] = np.arange(int(ends.sum()))
        sa = suffix_array(apart)
        self.bwt = symbols[sa - 1]  # before the first place stands the last, an end
        count = np.bincount(symbols, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(count)[:-1]])
        self.matrix = WaveletMatrix(self.bwt, sigma)
        self.n, self.sample = len(symbols), sample
        # kept: every sample-th place, and each document's first, so that no walk leaves a document
        self.kept = (sa % sample == 0) | (self.bwt == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)])
        self.places = sa[self.kept]

    def search(self, text: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern, a piece of ``text``."""
        lo, hi = np.zeros(len(begins), np.int64), np.full(len(begins), self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        back = 1
        while len(live):
            s = text[begins[live] + lengths[live] - back]
            lo[live] = self.first[s] + self.matrix.rank(s, lo[live])
            hi[live] = self.first[s] + self.matrix.rank(s, hi[live])
            back += 1
            live = live[(lo[live] < hi[live]) & (lengths[live] >= back)]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each suffix in the text."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            done = self.kept[r]
            out[live[done]] = self.places[self.kept_before[r[done]]] + steps[live[done]]
            live, r = live[~done], r[~done]
            s = self.bwt[r]
            rows[live] = self.first[s] + self.matrix.rank(s, r)
            steps[live] += 1
        return out


class Block(NamedTuple):
    """A part of the benchmark: its words' hashes (sorted), the items' words one after another as symbols from 2, each window's begin and length, its item, and the items' ids."""

    words: np.ndarray
    text: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    item: np.ndarray
    ids: list[str | None]


def make_block(ids: list[str | None], hashed: list[np.ndarray], window: int = WINDOW) -> Block:
    size = np.array([len(h) for h in hashed], dtype=np.int64)
    words, number = np.unique(np.concatenate([np.empty(0, np.uint64), *hashed]), return_inverse=True)
    # windows of each item: size - window + 1, one for a shorter item, none without words
    n = np.where(size >= window, size - window + 1, np.minimum(size, 1))
    offs = np.concatenate([[0], np.cumsum(n)])
    item = row_of(offs)
    begins = (np.cumsum(size) - size)[item] + np.arange(offs[-1]) - offs[:-1][item]
    return Block(words, (number + 2).astype(np.int32), begins.astype(np.int32), np.minimum(size, window)[item].astype(np.int32), item.astype(np.int32), ids)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offs in text_chunks(batch.column("text")):
            low = LOWER[data]
            starts, ends, wofs = runs(WORD_BYTES[low], offs)
            lists = pa.ListArray.from_arrays(pa.array(wofs.astype(np.int32)), pa.array(hashes(low, starts, ends).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), lists], names=["id", "words"])


def blocks_of(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of at most ``block_words`` words (or one item), one at a time."""
    rows = staged(benchmark.select(F.col("item_id").cast("string").alias("id"), "text").mapInArrow(_item_words, "id string, words array<long>").filter(F.size("words") > 0), "items")
    ids, held, n = [], [], 0
    for r in rows.toLocalIterator():
        if ids and n + len(r["words"]) > block_words:
            yield make_block(ids, held, window)
            ids, held, n = [], [], 0
        ids.append(r["id"])
        held.append(np.array(r["words"], dtype=np.int64).view(np.uint64))
        n += len(r["words"])
    if ids:
        yield make_block(ids, held, window)


class Found(NamedTuple):
    """What a shard holds: word begins, ends and offsets; hit ranges of words as (row, first, after the last), merged; (row, item) pairs."""

    starts: np.ndarray
    ends: np.ndarray
    offs: np.ndarray
    ranges: np.ndarray
    pairs: np.ndarray


def find_hits(data: np.ndarray, offs: np.ndarray, block: Block) -> Found:
    """All windows of the block in one shard."""
    low = LOWER[data]
    starts, ends, wofs = runs(WORD_BYTES[low], offs)
    docs = len(offs) - 1
    rows = row_of(wofs)
    nothing = Found(starts, ends, wofs, np.empty((0, 3), np.int64), np.empty((0, 2), np.int64))
    if not len(starts) or not len(block.begins):
        return nothing
    h = hashes(low, starts, ends)
    at = np.minimum(np.searchsorted(block.words, h), len(block.words) - 1)
    symbol = np.where(block.words[at] == h, at + 2, 1).astype(np.int32)
    del low, h, at
    # only windows all of whose words the shard has can be found
    here = np.zeros(len(block.words) + 2, dtype=bool)
    here[symbol] = True
    gaps = np.concatenate([[0], np.cumsum(~here[block.text])])
    tried = np.flatnonzero(gaps[block.begins + block.lengths] == gaps[block.begins])
    if not len(tried):
        return nothing
    # a run of other words is one symbol; each document ends with a 0
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = (symbol[1:] != 1) | (symbol[:-1] != 1) | (rows[1:] != rows[:-1])
    kept = np.flatnonzero(keep)
    end_at = np.searchsorted(kept, wofs[1:]) + np.arange(docs)  # behind the document's last word
    text, word = np.zeros(len(kept) + docs, np.int32), np.full(len(kept) + docs, -1, np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[end_at] = False
    text[inside], word[inside] = symbol[kept], kept
    index = FMIndex(text, len(block.words) + 2)
    lo, hi = index.search(block.text, block.begins[tried].astype(np.int64), block.lengths[tried].astype(np.int64))
    n = hi - lo
    hit = np.flatnonzero(n)
    if not len(hit):
        return nothing
    offset = np.concatenate([[0], np.cumsum(n[hit])])
    of = row_of(offset)
    first = word[index.locate(lo[hit][of] + np.arange(offset[-1]) - offset[:-1][of])]
    which = tried[hit[of]]
    mark = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + block.lengths[which], -1)
    s, e, _ = runs(np.cumsum(mark[:-1]) > 0, wofs)
    ranges = np.stack([rows[s], s - wofs[rows[s]], e - wofs[rows[s]]], axis=1)
    return nothing._replace(ranges=ranges, pairs=np.unique(np.stack([rows[first], block.item[which].astype(np.int64)], axis=1), axis=0))


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: What one block's pass adds to a document, and the verdict after the last.
HITS = "struct<ranges: array<int>, items: array<string>>"
VERDICT = "struct<n_words: long, n_hit: long, n_items: long, items_sha256: string, contaminated: boolean, cut: string>"
_HITS = pa.struct([("ranges", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
_VERDICT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("cut", pa.string())])
_NO_ITEMS = hashlib.sha256(b"").hexdigest()


def _all_hits(found: Found, block: Block, prior: pa.Array | None, a: int) -> dict[int, tuple[list[tuple[int, int]], set[str | None]]]:
    """Of the rows with hits, here or before: their ranges of words and items."""
    out: dict[int, tuple[list[tuple[int, int]], set[str | None]]] = {}
    for r, x, y in found.ranges.tolist():
        out.setdefault(r, ([], set()))[0].append((x, y))
    for r, k in found.pairs.tolist():
        out[r][1].add(block.ids[k])
    if prior is not None:
        before = prior.slice(a, len(found.offs) - 1)
        for r in np.flatnonzero(before.field("items").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)):
            old = before[int(r)].as_py()
            ranges, items = out.get(int(r), ([], set()))
            pairs = list(zip(old["ranges"][::2], old["ranges"][1::2], strict=True))
            out[int(r)] = (merge_ranges([*ranges, *pairs]), items | set(old["items"]))
    return out


def _judge(sent: Broadcast | None, last: bool, cut: bool):
    """The Arrow function of a block: (text, hits of the blocks before) -> hits so far, or the verdict."""

    def run(text: pa.Array, prior: pa.Array | None = None) -> pa.Array:
        block = sent.value if sent is not None else make_block([], [])
        done: list[pa.Array] = []
        for a, b, data, offs in text_chunks(text, SHARD_BYTES):
            found = find_hits(data, offs, block)
            rows = _all_hits(found, block, prior, a)
            if not last:
                flat = [None if k not in rows else {"ranges": [x for r in rows[k][0] for x in r], "items": list(rows[k][1])} for k in range(b - a)]
                done.append(pa.array(flat, _HITS))
                continue
            n = np.diff(found.offs)
            n_hit, n_items, digest, texts = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), [_NO_ITEMS] * (b - a), [None] * (b - a)
            for k, (ranges, items) in rows.items():
                n_hit[k], n_items[k] = sum(y - x for x, y in ranges), len(items)
                digest[k] = hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()
                if cut and SHARE * n_hit[k] >= n[k]:
                    raw, at, parts = data[offs[k] : offs[k + 1]].tobytes(), 0, []
                    for x, y in ranges:
                        w = found.offs[k]
                        parts.append(raw[at : found.starts[w + x] - offs[k]])
                        at = found.ends[w + y - 1] - offs[k]
                    texts[k] = b"\n".join([*parts, raw[at:]]).decode()
            done.append(pa.StructArray.from_arrays([pa.array(n), pa.array(n_hit), pa.array(n_items), pa.array(digest, pa.string()), pa.array((n_hit > 0) & (SHARE * n_hit >= n)), pa.array(texts, pa.string())], fields=list(_VERDICT)))
        return pa.concat_arrays(done) if done else pa.array([], _VERDICT if last else _HITS)

    def one(text: pa.Array) -> pa.Array:
        return run(text)

    def more(text: pa.Array, prior: pa.Array) -> pa.Array:
        return run(text, prior)

    return one, more


def judged(docs: DataFrame, benchmark: DataFrame, name: str, cut: bool = False, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with one more column ``name``: the verdict of every row (n_words, n_hit, n_items, items_sha256, contaminated, and the text without its spans if ``cut``)."""
    spark, prior = docs.sparkSession, fresh(docs, "_hits")
    blocks = blocks_of(benchmark, window, block_words)
    block = next(blocks, None)
    out = docs
    while True:
        after = next(blocks, None)
        sent = spark.sparkContext.broadcast(block) if block is not None else None
        one, more = _judge(sent, after is None, cut)
        first = prior not in out.columns
        kind = VERDICT if after is None else HITS
        # non-deterministic: Spark would run it again for a filter above
        f = F.arrow_udf(one if first else more, kind).asNondeterministic()
        value = f(F.col("text")) if first else f(F.col("text"), F.col(prior))
        if after is None:
            return out.select(*columns_of(docs), value.alias(name))
        out = staged(out.select(*columns_of(docs), value.alias(prior)), "hits")
        sent.destroy()
        block = after


def contamination(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return judged(docs.select("doc_id", "text"), benchmark, "verdict", **options).select("doc_id", *[f"verdict.{n}" for n in names])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """``docs`` where contaminated documents have lost their merged spans (a line break stands for each); others are unchanged."""
    v = fresh(docs, "_verdict")
    cut = F.col(v)["cut"]
    out = {"text": F.coalesce(cut, F.col("text"))}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(cut.isNotNull(), F.length(cut)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    plain = dict(zip(docs.columns, columns_of(docs), strict=True)) | out
    return judged(docs, benchmark, v, cut=True, **options).select(*[c.alias(k) for k, c in plain.items()])
