"""The K-d tree, the byte network and the label model against plain Python, row by row."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from loomgrid.llm import langid, shard, toxicity

DOC = "doc_id long, text string, lang string, source string"
EDGES = [None, "", " \n\t", "7", "a", "Aé", "日本語", "x" * 3000, "Ab " * 64, "Ab " * 65, "ß" * 100]


def docs_of(spark, n=400):
    r = random.Random(3)
    letters = {"aa": "abcdefgh ", "bb": "mnopqrst ", "cc": "äöüéèñçß "}
    rows = [(k, t, "aa", None) for k, t in enumerate(EDGES)]
    for k in range(len(EDGES), n):
        lang = r.choice(sorted(letters))
        rows.append((k, "".join(r.choice(letters[lang]) for _ in range(r.choice([5, 40, 200, 900]))), lang, r.choice(["hot", "hot", "s1", None])))
    # copies of one text, which a cut may part only where none can pass them by
    rows += [(n + k, "the same text again", "bb", "hot") for k in range(40)]
    return spark.createDataFrame(rows, DOC)


def leaf(node, row):
    while node.cut is not None:
        dim, at, left, right = node.cut
        node = left if row[dim] < at else right
    return node.first


def check_cuts(node, rows):
    """Every cut is on the widest dimension, and as near to the goal as any cut between two keys (but for the slack)."""
    if node.leaves == 1:
        assert node.cut is None
        return 1
    dim, at, left, right = node.cut
    assert (left.leaves, right.leaves) == (node.leaves // 2, node.leaves - node.leaves // 2)
    if rows:
        width = {d: (max(r[d] for r in rows) >> shard.TIE_BITS) - (min(r[d] for r in rows) >> shard.TIE_BITS) for d in shard.DIMENSIONS}
        assert width[dim] == max(width.values())
        total = sum(r["size"] for r in rows)
        goal, below, nearest = total * left.leaves / node.leaves, 0, math.inf
        ordered = sorted(rows, key=lambda r: r[dim])
        for k, r in enumerate(ordered):
            if not k or ordered[k - 1][dim] < r[dim]:
                nearest = min(nearest, abs(below - goal))
            below += r["size"]
        nearest = min(nearest, abs(below - goal))
        got = sum(r["size"] for r in rows if r[dim] < at)
        assert abs(got - goal) <= nearest + shard.SLACK * total / node.leaves + 1e-6
    return check_cuts(left, [r for r in rows if r[dim] < at]) + check_cuts(right, [r for r in rows if r[dim] >= at])


def test_tree_against_plain_medians(spark):
    docs = docs_of(spark)
    slim = shard.slim_rows(docs, F.monotonically_increasing_id())
    for shards in (1, 7, 40):
        keyed = shard.keyed(slim, shard.groups_of(slim, shards))
        rows = keyed.collect()
        tree = shard.build_tree(keyed, shards)
        assert check_cuts(tree, rows) == shards
        got = {r["doc_id"]: r["shard"] for r in shard.assign_shards(docs, shards).collect()}
        assert got == {r["doc_id"]: leaf(tree, r) for r in rows}


def plain_probabilities(text, net):
    """Mean over the windows of softmax(max pooling(convolutions)), by loops."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    size, total = langid.WINDOW, [0.0] * len(net.languages)
    count = max(1, -(-len(raw) // size))
    for k in range(count):
        begin = min(k * size, max(len(raw) - size, 0))
        x = raw[begin : begin + size].ljust(size, b"\0")
        pooled = []
        for table, bias in zip(net.tables, net.biases, strict=True):
            t, w = table.tolist(), len(table)
            for f in range(len(bias)):
                pooled.append(max(0.0, max(sum(t[o][x[p + o]][f] for o in range(w)) for p in range(size - w + 1)) + float(bias[f])))
        z = [float(net.bias[j]) + sum(v * float(net.weights[i][j]) for i, v in enumerate(pooled)) for j in range(len(net.languages))]
        e = [math.exp(v - max(z)) for v in z]
        total = [a + b / sum(e) for a, b in zip(total, e, strict=True)]
    return [a / count for a in total]


def test_network_against_plain_loops(spark):
    docs = docs_of(spark, 160)
    net = langid.train(*langid.sample_windows(docs), epochs=2)
    texts = {r["doc_id"]: r["text"] for r in docs.filter(F.col("doc_id") < 60).collect()}
    for r in langid.predict(docs.filter(F.col("doc_id") < 60), net).collect():
        text = texts[r["doc_id"]] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        p = plain_probabilities(text, net)
        assert abs(r["score"] - max(p)) < 1e-4
        assert p[net.languages.index(r["lang_pred"])] > max(p) - 1e-4


def test_equal_texts_share_a_shard(spark):
    """Whatever their sources and languages, unless a group is larger than a leaf; bytes stay even."""
    rows = [(k, f"text {k} " + "word " * (k % 50), f"s{k % 5}", ["en", "fr", None][k % 3]) for k in range(2000)]
    rows += [(3000 + k, f"copy {k % 100} " + "of a text " * 5, f"s{k % 7}", ["en", "de", None, "fr"][k % 4]) for k in range(400)]
    rows += [(4000 + k, None, f"s{k % 3}", "en") for k in range(20)] + [(5000 + k, "hot " * 30, f"s{k % 5}", "en") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(4)
    size = lambda t: 16 + len(t or "")
    total = sum(size(r[1]) for r in rows)
    for got in ({r["doc_id"]: r["shard"] for r in df.select("doc_id", "shard").collect()} for df in (shard.assign_shards(docs, 10), shard.shard_documents(docs, 10))):
        of, held = {}, [0] * 10
        for i, text, _, _ in rows:
            of.setdefault(text, set()).add(got[i])
            held[got[i]] += size(text)
        assert all(len(s) == 1 for t, s in of.items() if not (t or "").startswith("hot ")) and len(of["hot " * 30]) > 1
        assert max(held) - min(held) < 0.05 * total / 10


def test_sample_of_languages_is_bounded_by_rows(spark):
    """Rows without an id, or with the same one, are drawn one by one; equal rows come once."""
    en = [(None, f"english words of text {k}", "en") for k in range(1500)] + [(7, f"more english {k}", "en") for k in range(1500)]
    fr = [(None, f"des mots en texte {k}", "fr") for k in range(3000)]
    de = [(k, f"deutsche worte {k}", "de") for k in range(40)] + [(99, "immer das gleiche", "de")] * 3000
    docs = spark.createDataFrame(en + fr + de, "doc_id long, text string, lang string").repartition(4)
    _, langs = langid.sample_windows(docs, 300)
    n = {x: langs.count(x) for x in {*langs}}
    assert abs(n["en"] - 300) < 100 and abs(n["fr"] - 300) < 100 and n["de"] == 41


def plain_em(votes, start, rounds):
    """Expectation maximisation with loops: rates by class, one shrunk covariance, posteriors."""
    n, m, post = len(votes), len(votes[0]), list(start)
    for _ in range(rounds):
        share = [sum(1 - p for p in post), sum(post)]
        rate = [[sum((p if c else 1 - p) * v[j] for p, v in zip(post, votes, strict=True)) / share[c] for j in range(m)] for c in (0, 1)]
        left = [[v[j] - (1 - p) * rate[0][j] - p * rate[1][j] for j in range(m)] for p, v in zip(post, votes, strict=True)]
        cov = np.array([[sum(r[a] * r[b] for r in left) / n * (1.0 if a == b else 0.8) + (1e-3 if a == b else 0.0) for b in range(m)] for a in range(m)])
        weights = np.linalg.solve(cov, np.array(rate[1]) - np.array(rate[0]))
        prior = min(max(sum(post) / n, 1e-3), 1 - 1e-3)
        logit = [sum(weights[j] * (v[j] - (rate[0][j] + rate[1][j]) / 2) for j in range(m)) + math.log(prior / (1 - prior)) for v in votes]
        post = [min(max(1 / (1 + math.exp(-min(max(x, -30), 30))), 1e-4), 1 - 1e-4) for x in logit]
    return post


def votes_of(n=300):
    """Six voters, the last two of them correlated, of different accuracy; the truth."""
    r, votes, truth = random.Random(5), [], []
    for _ in range(n):
        y = r.random() < 0.3
        one = [float(r.random() < (hit if y else miss)) for hit, miss in ((0.8, 0.05), (0.7, 0.1), (0.6, 0.05), (0.5, 0.2), (0.6, 0.1))]
        votes.append([*one, one[-1] if r.random() < 0.9 else 1 - one[-1]])
        truth.append(int(y))
    return votes, truth


def test_label_model_against_plain_expectation_maximisation():
    votes, truth = votes_of()
    start = [0.9 if sum(v) > 2 else 0.1 for v in votes]
    for rounds in (1, 3, 8):
        _, got = toxicity.fit_label_model(np.array(votes), np.array(start), rounds)
        # the operator stops where nothing changes any more
        assert max(abs(a - b) for a, b in zip(got, plain_em(votes, start, rounds), strict=True)) < 2e-3
    _, got = toxicity.fit_label_model(np.array(votes), np.array(start))
    assert sum((p > 0.5) == y for p, y in zip(got, truth, strict=True)) > 0.9 * len(truth)


def test_votes_and_not_labels_make_the_posterior(spark, monkeypatch):
    """Texts full of lexicon words with a wrong label are toxic to the label model, and count little in training."""
    docs, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        docs.append((k, f"wretched vermin go away number{k} you filth" if toxic else f"a quiet afternoon number{k} by the river"))
        labels.append((k, int(toxic and k % 40 != 0)))  # every tenth toxic text is labelled 0
    seen = {}
    fit = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda x, target, count: seen.update(target=target, count=count) or fit(x, target, count))
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(False))
    wrong = [k for k in range(400) if k % 40 == 0]
    assert model is not None and all(seen["target"][k] > 0.5 and seen["count"][k] < 0.5 for k in wrong)
    assert all(seen["count"][k] > 0.5 for k in range(400) if k not in wrong)


def test_toxicity_learns_one_text_of_an_id(spark, monkeypatch):
    """A labelled id on thousands of rows, and null ids, don't enlarge what reaches the driver."""
    docs = [(k, f"{'nasty insult' if k % 2 else 'kind words'} {k}") for k in range(40)] + [(7, f"another text {k}") for k in range(3000)] + [(None, "nasty insult")] * 50
    seen = []
    fit = toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_linear", lambda x, target, count: seen.append(len(x)) or fit(x, target, count))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1)], "doc_id long, toxic int")
    assert toxicity.classify(df, labels, F.lit(False)).count() == len(docs) and seen == [40]
