"""The pipeline against a plain version of its stages."""

import hashlib
import math
import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
from loomgrid.llm import quality

from .test_corpus import BWORD, brute_components, brute_hits, lower, near_copies, words_of


def plain_quality(docs):
    """Documents kept by the base rules and by the distance to the nearest language."""
    classes = lambda t: [sum(f(c) for c in t) for f in (str_class(k) for k in range(7))]

    def str_class(k):
        def f(c):
            kind = 6 if ord(c) > 127 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c in ".,;:'\"?()-" else 5 if c in " \t\n\r\v\f" else 4
            return kind == k

        return f

    refs = {}
    for d in docs:
        r = refs.setdefault(d["lang"], [Counter(), Counter(), 0, 0])
        r[0].update(dict(enumerate(classes(d["text"] or ""))))
        w = [lower(w) for w in words_of(d["text"])]
        r[1].update(w)
        r[2] += len(w)
        r[3] += bool(w)
    level = {k: 0 if k is None else 2 if r[3] >= quality.LEAST_DOCS and r[2] >= quality.LEAST_TEXT else 1 for k, r in refs.items() if r[2]}
    refs = {k: refs[k] for k in level if level[k] == max(level.values())}
    for r in refs.values():
        r[1] = {w: n for w, n in r[1].items() if n * quality.RAREST >= r[2] and sum(m >= n for m in r[1].values()) <= quality.COMMON}

    def distance(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda x: sum(a * math.log2(a / c) for a, c in zip(x, m) if a > 0)
        return math.sqrt(min(max((kl(p) + kl(q)) / 2, 0), 1))

    out = []
    for d in docs:
        w = words_of(d["text"])
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        rep = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)}
        if len(w) < 50 or 100 * len(rep) > 50 * len(w):
            continue
        c = classes(d["text"])
        mine = Counter(lower(x) for x in w)
        by_class, by_word = 1.0, 1.0
        for ref in refs.values():
            total = sum(ref[0].values())
            of_class = distance([x / sum(c) for x in c], [ref[0][k] / total for k in range(7)])
            by_class = min(by_class, of_class)
            p, q = [mine[x] / len(w) for x in ref[1]], [n / ref[2] for n in ref[1].values()]
            if sum(q) < quality.LEAST_MASS:
                by_word = 0.0 if of_class <= quality.MOST_CLASS_DISTANCE else by_word
                continue
            none = distance([0.0] * len(q) + [1.0], [*q, 1 - sum(q)])
            by_word = min(by_word, distance([*p, 1 - sum(p)], [*q, 1 - sum(q)]) / none)
        if by_class <= quality.MOST_CLASS_DISTANCE and (by_word <= quality.MOST_WORD_DISTANCE or len(w) < quality.LEAST_WORDS_COMMON):
            out.append(d)
    return out


def plain_cut(text, items):
    """The text without hit words' spans, if it is contaminated."""
    if not brute_hits(text, items)[4]:
        return text
    found = list(BWORD.finditer(lower(text)))
    w, hit = [m[0] for m in found], set()
    for _, t in items:
        x = BWORD.findall(lower(t))
        n = min(13, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[k : k + n]:
                    hit |= set(range(p, p + n))
    out, at, p = [], 0, 0
    while p < len(w):
        if p in hit:
            q = p
            while q + 1 in hit:
                q += 1
            out.append(text[at : found[p].start()])
            at, p = found[q].end(), q
        p += 1
    return "\n".join([*out, text[at:]])


def plain_mix(docs):
    """Copies of each document."""
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(d)
    names = sorted([s for s in by if s is not None]) + ([None] if None in by else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(len(words_of(d["text"])) for d in v) for s, v in by.items()}
    full, left = {}, 1.5 * sum(size.values())
    while True:
        free = [s for s in names if s not in full]
        share = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            break
        full |= {s: 2.0 * size[s] for s in over}
    out = Counter()
    for s, v in by.items():
        rate = min(full.get(s, share.get(s)) / size[s], 2.0) if size[s] else 0.0
        u = int(hashlib.md5(f"7:{'null' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) / 2**32
        order = sorted(v, key=lambda d: (len(words_of(d["text"])), hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:3], d["doc_id"]))
        for k, d in enumerate(order, 1):
            out[d["doc_id"]] += math.floor(k * rate + u) - math.floor((k - 1) * rate + u)
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    r = random.Random(12)
    voc = {"en": ["the", "of", "and", "to", "in", "word", "house", "tree", "going", "around"] + [f"en{k}x" for k in range(150)], "fr": ["le", "la", "de", "et", "un", "mot", "était"] + [f"fé{k}y" for k in range(150)]}
    text = lambda l, n: " ".join(r.choice(voc[l][:10]) if r.random() < 0.4 else r.choice(voc[l]) for _ in range(n))
    items = [(k, text("en", 20)) for k in range(6)]
    texts = [(text(l, r.randint(20, 150)), l) for l in ("en", "fr") for _ in range(60)]
    texts += [(t, "en") for t in near_copies([t for t, l in texts[:20] if len(t.split()) > 60])]
    texts += [(text("en", 60) + " " + items[k % 6][1] + ". " + text("en", 40), "en") for k in range(10)]
    texts += [("### $$$ " * 60, "en"), (None, None), ("", "fr"), ("same " * 80, "en")]
    rows = [(k, t, l, [None, "a", "b", "c"][k % 4], len(t or "")) for k, (t, l) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [dict(zip(("doc_id", "text", "lang", "source"), x)) for x in rows]
    docs = plain_quality(docs)
    kept = brute_components([d["text"] for d in docs], 5, 80)
    docs = [d for d, k in zip(docs, kept) if k[3]]
    docs = [d | {"text": plain_cut(d["text"], items)} for d in docs]
    copies = plain_mix(docs)
    gold = Counter({(d["doc_id"], d["text"]): copies[d["doc_id"]] for d in docs})
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(docs) > 60 and Counter((x["doc_id"], x["text"]) for x in got) == +gold
    assert all(0 <= x["shard"] < 40 for x in got)
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "shard"}


def test_pipeline_on_a_long_text_repeated_rows_and_clashing_names(spark, tmp_path):
    r = random.Random(4)
    common = ["the", "of", "and", "to", "in", "word", "house", "tree", "going", "around"]
    text = lambda n, rare: " ".join(r.choice(common) if r.random() < 0.4 else f"en{r.randrange(rare)}x" for _ in range(n))
    items = [(0, text(20, 150))]
    texts = [text(r.randint(60, 150), 150) for _ in range(60)] + [text(700_000, 90_000)]
    assert len(texts[-1]) > 4_000_000
    names = ["id", "n", "_key", "rep", "band", "component", "kept", "size", "node", "shard", "words", "key", "hash", "_host"]
    rows = [(k, t, "en", "abc"[k % 3], len(t), *[str(k)] * len(names)) for k, t in enumerate(texts)]
    rows += rows[:20] * 3
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    there = {p.name for p in shared.iterdir()} if shared.exists() else set()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = Counter(p.name.rsplit("-", 1)[0] for p in shared.iterdir() if p.name not in there)
    # of the first four stages only the last one's documents are left
    assert left["mixing"] == 1 and not {"quality-rules", "near-dedup", "decontamination", "sketch", "sets", "links"} & set(left)
    copies = plain_mix([{"doc_id": k, "text": t, "source": "abc"[k % 3]} for k, t in enumerate(texts)])
    got = out.select("doc_id", "text", "n_chars", "shard", *[n for n in names if n != "shard"]).collect()
    assert Counter(x["doc_id"] for x in got) == +copies and copies[len(texts) - 1] > 0
    assert all(x["text"] == texts[x["doc_id"]] and all(x[n] == str(x["doc_id"]) for n in names if n != "shard") and 0 <= x["shard"] < 40 for x in got)
