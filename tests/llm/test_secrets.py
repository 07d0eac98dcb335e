"""Candidates of the secret scan against a plain search, character by character."""

import random
import string
import time
from collections import Counter

from loomgrid.llm import secretscan

from .test_corpus import docs_of

SPACE = " \t\n\v\f\r"
LETTERS = frozenset(string.ascii_letters + string.digits + "+/_-")


def split_words(text):
    """Words as split by runs of white space; an empty one at either end counts."""
    out, word, gap = [], "", False
    for c in text:
        if c in SPACE:
            if not gap:
                out.append(word)
            word, gap = "", True
        else:
            word, gap = word + c, False
    return [*out, word]


def tokens(word):
    """Runs of 16 or more token characters with a digit, and up to two equals signs after each."""
    out, k = [], 0
    while k < len(word):
        end = k
        while end < len(word) and word[end] in LETTERS:
            end += 1
        if end - k >= 16 and any(c in string.digits for c in word[k:end]):
            tail = 0
            while tail < 2 and word[end + tail : end + tail + 1] == "=":
                tail += 1
            out.append(word[k : end + tail])
        k = max(end, k + 1)
    return out


def ends_named(word):
    """Does the word end in a name of a credential, its plural, or either with one quote?"""
    w = word.lower()
    w = w[:-1] if w.endswith(("'", '"')) else w
    return w.endswith(secretscan.NAMES) or (w.endswith("s") and w[:-1].endswith(secretscan.NAMES))


def value_at(word, k):
    """The value from place k: up to white space, a quote, comma, semicolon or the next parameter of an address."""
    end = k
    while end < len(word) and word[end] not in SPACE + "\"',;":
        if word[end] == "&":
            n = end + 1
            while n < len(word) and word[n] in string.ascii_letters + string.digits + "_-":
                n += 1
            if 1 <= n - end - 1 <= 64 and word[n : n + 1] == "=":
                break
        end += 1
    return word[k:end] if end - k >= 8 else ""


def assigned(word):
    """Values after a name and marks of assignment inside the word; a name inside a value names nothing more."""
    out, k, last = [], 0, 0
    while k < len(word):
        if word[k] in ":=" and ends_named(word[last:k]):
            n = k
            while n < len(word) and word[n] in ":=":
                n += 1
            n += word[n : n + 1] in ("'", '"') and n < len(word)
            if value := value_at(word, n):
                out.append(value)
                k = last = n + len(value)
                continue
        k += 1
    return out


def leading(word):
    """The value at the word's begin, after marks and a quote."""
    n = len(word) - len(word.lstrip(":="))
    n += n < len(word) and word[n] in "'\""
    end = n
    while end < len(word) and word[end] not in SPACE + "\"',;":
        end += 1
    return word[n:end] if end - n >= 8 else ""


def marks(word):
    """Is it marks of assignment only?"""
    return bool(word) and not word.strip(":=")


def plain_findings(text):
    w, out = split_words(text), []
    for k, word in enumerate(w):
        b1, b2 = (w[k - 1] if k > 0 else ""), (w[k - 2] if k > 1 else "")
        bare = b1.rstrip(":=")
        follows = (bare != b1 and ends_named(bare)) or (ends_named(b1) and word[:1] in (":", "=") and word != "") or (marks(b1) and ends_named(b2))
        values = list(dict.fromkeys(v for v in ([leading(word)] if follows else []) + assigned(word) if v))
        free = [t for t in dict.fromkeys(tokens(word)) if not any(t in v for v in values)]
        out += [(k + 1, v, True) for v in values] + [(k + 1, t, False) for t in free]
    return out


def made_text(r):
    parts = ["=", ":", ": ", " = ", " ", " ", "\n", "'", '"', ",", ";", "&", "?", "/", "Ab3dEf6hIj9lMn2pQr", "hunter2hunter2", "0123456789abcdef", "abcdefghijklmnopqrst", "&user=", "==", "é", "the", "\t"]
    parts += [n if r.random() < 0.6 else n.upper() for n in secretscan.NAMES] + ["tokens", "my_secret", "keys'"]
    return "".join(r.choice(parts) for _ in range(r.randrange(1, 60)))


def test_candidates_against_a_plain_search(spark):
    r = random.Random(31)
    texts = [made_text(r) for _ in range(1500)] + ["", None, " ", "key= Ab3dEf6hIj9lMn2p", "token : 'hunter2hunter2' x"]
    got = Counter((x["doc_id"], x["ordinal"], x["value"], x["is_assigned"]) for x in secretscan.findings(docs_of(spark, texts)).collect())
    gold = Counter((k, *f) for k, t in enumerate(texts) if t for f in plain_findings(t))
    assert sum(gold.values()) > 2000
    assert sorted((got - gold).items()) == sorted((gold - got).items()) == []


def test_many_candidates_of_one_text(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choices(string.ascii_letters, k=12)) + f"{k:08d}" for k in range(n))
    took = []
    for n in (8_000, 64_000):
        found = secretscan.findings(docs_of(spark, [text(n)]))
        began = time.monotonic()
        assert found.count() == n and found.select("value").distinct().count() == n
        took.append(time.monotonic() - began)
    # eight times the candidates take nowhere near 64 times as long
    assert took[1] < 30 * max(took[0], 0.5), took
