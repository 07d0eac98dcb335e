"""Every operator and stage on nulls, empties, ties, repeated rows, a very long text, empty tables and clashing columns."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from loomgrid.llm import decontam, htmltext, langid, mixing, neardup, quality, secretscan, shard, toxicity, warc
from loomgrid.llm.common import is_held_out

from .test_corpus import brute_components, random_texts

LONG = " ".join(random.Random(1).choice(["the", "of", "tree", "house", "word"]) + str(k % 997) for k in range(700_000))
TEXTS = [None, "", " \n\t", "a", "same text of a few words here", LONG, *random_texts(12, 3, most=200)]
CLASH = ("kept", "n_words", "_verdict", "_hits", "_key", "_row", "cell", "row", "shard", "k", "key_length", "score", "contaminated", "size", "copies")


@pytest.fixture(scope="module")
def docs(spark):
    """Every text twice under one id, once more without an id, and columns that are named like those of operators."""
    rows = []
    for k, t in enumerate(TEXTS):
        row = (k, t, [None, "en", "fr"][k % 3], [None, "a"][k % 2], None if t is None else len(t))
        rows += [row, row, (None, *row[1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in CLASH}).repartition(5)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, TEXTS[8]), (None, TEXTS[9]), (2, None), (3, "")], "item_id long, text string")


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_documents_with_edges(spark, docs, bench):
    n = docs.count()
    assert shard.assign_shards(docs, 4).count() == n
    whole = shard.shard_documents(docs, 4)
    assert rows_of(whole) == rows_of(docs) and sorted(whole.columns) == sorted(docs.columns)
    assert {r["shard"] for r in whole.select("shard").collect()} <= set(range(4))
    assert langid.identify(docs).filter("score BETWEEN 0 AND 1").count() == n
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).filter("score BETWEEN 0 AND 1").count() == n
    assert secretscan.scan(docs).filter("score BETWEEN 0 AND 1").count() >= 0
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and quality.judge_quality(docs).count() == n
    assert decontam.contamination(docs, bench).count() == n
    cut = decontam.remove_contamination(docs, bench)
    assert cut.columns == docs.columns and cut.count() == n and cut.filter("text IS NULL").count() == 3
    assert cut.filter("doc_id = 8 AND trim(translate(text, '\\n', ' ')) <> ''").count() == 0 and cut.filter("length(text) <> n_chars").count() == 0
    plan = mixing.mix_plan(docs)
    assert plan.count() == n
    mixed = mixing.apply_mix(docs)
    taken = plan.agg({"taken": "sum"}).first()[0]
    assert mixed.columns == docs.columns and mixing.mix_plan(mixed).agg({"size": "sum"}).first()[0] == taken


def test_near_duplicates_of_repeated_rows(docs):
    kept = neardup.drop_near_duplicates(docs)
    gold = brute_components([t for t in TEXTS if t is None or len(t) < 1_000_000], 5, 80)
    assert kept.columns == docs.columns
    # one of each text (rows without an id come first); texts without words are linked with nothing but equal rows
    got = rows_of(kept)
    assert max(got.values()) == 1 and len({t for _, t in got}) == len(TEXTS)
    assert sum(1 for _, t in got if t is not None and t.strip()) == sum(1 for *_, k in gold if k) - 3 + 1
    assert neardup.near_duplicates(docs).count() == docs.count()


def test_ids_of_other_types(spark):
    rows = [("a", "one two three four five six"), ("b", "one two three four five six"), ("c", "other")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "'x' AS lang", "'s' AS source")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c"}
    bench = spark.createDataFrame([("q", "three four five")], "item_id string, text string")
    assert {r["doc_id"] for r in decontam.contamination(docs, bench).filter("contaminated").collect()} == {"a", "b"}
    assert shard.assign_shards(docs, 2).count() == mixing.mix_plan(docs).count() == langid.identify(docs).count() == 3


def test_empty_tables(spark, docs, bench, tmp_path):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for got in (langid.identify(none), toxicity.classify(none, labels), secretscan.scan(none), quality.keep_good(none), neardup.drop_near_duplicates(none), decontam.remove_contamination(none, bench), decontam.remove_contamination(none, bench.limit(0)), mixing.apply_mix(none), shard.shard_documents(none, 3), htmltext.extract_text(pages), warc.read_archives(warc.write_archives(pages))):
        assert got.count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pages_with_edges(spark):
    long = "<p>" + "word " * 1_000_000
    rows = [(k, f"http://h/{k}", h) for k, h in enumerate([None, "", "<p>", "<p>a", "<p>a", long])] + [(3, "http://h/3", "<p>a"), (None, None, "<p>b")]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "text", "size", "digest", "_templates", "archive")})
    got = htmltext.extract_text(pages)
    assert got.count() == len(rows) and got.filter("page_id = 5").first()["n_chars"] == 5_000_000 - 1
    back = warc.read_archives(warc.write_archives(pages))
    assert back.count() == len(rows) and back.filter("problem IS NOT NULL").count() == 0 and back.filter("page_id = 5").first()["html"] == long


def test_equal_rows_are_cut_evenly(spark):
    rows = [(1, "same text again", "en", "s")] * 1000 + [(k, f"other {k} " * (k % 7), "en", "s") for k in range(58)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    size = [0] * 4
    for r in shard.assign_shards(docs, 4).collect():
        size[r["shard"]] += r["size"]
    assert max(size) - min(size) < 0.1 * sum(size) / 4
    # equal texts stay together where they fit
    texts = [f"text number {k % 200}" for k in range(1000)]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    where = {}
    for r in shard.assign_shards(docs, 4).collect():
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(v) > 1 for v in where.values()) <= 3


def test_one_python_pass_for_all_blocks(spark, docs, bench):
    for block in (4_000_000, 20):
        plan = decontam.remove_contamination(docs, bench, block_words=block)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 0


def test_chain_in_any_order_is_one_component(spark):
    ids = list(range(1000))
    random.Random(5).shuffle(ids)
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "x long, y long")
    assert {r["component"] for r in neardup.components(edges).collect()} == {0}


def test_popular_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neardup, "POPULAR", 0)
    monkeypatch.setattr(neardup, "FIRST_BANDS", 0)
    from .test_corpus import docs_of, near_copies

    texts = near_copies(random_texts(25, 14))
    got = neardup.near_duplicates(docs_of(spark, texts), 2, 80)
    assert sorted(map(tuple, got.collect())) == brute_components(texts, 2, 80)


def test_pair_that_shares_only_large_buckets(spark, monkeypatch):
    """Two texts are at 0.8 and share ten buckets, all by words that 300 others have too, which are at 0.77 and less; neither has a bucket's first or last id."""
    from .test_corpus import docs_of

    r = random.Random(685)
    words = [f"w{r.randrange(10**6)}" for _ in range(81)]
    pair, crowd = ([" ".join(words + [f"v{r.randrange(10**6)}" for _ in range(own)]) for _ in range(n)] for own, n in ((10, 2), (14, 300)))
    texts = crowd[:150] + pair + crowd[150:]
    gold = brute_components(texts, 2, 80)
    assert gold[151][2] == 150 and sum(kept for *_, kept in gold) == 301
    for popular in (1000, neardup.POPULAR):
        monkeypatch.setattr(neardup, "POPULAR", popular)
        assert sorted(map(tuple, neardup.near_duplicates(docs_of(spark, texts), 2, 80).collect())) == gold


def test_templates_against_plain_counts(spark):
    pages = [(k, f"http://h{k % 2}/{k}", f"<body><nav>Menu {k % 2}</nav><div class=ad>ad {k % 9}</div><article><p>Story {k}</p></article><footer>Foot {k % 3}</footer></body>") for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for markup in (True, False):
        gold = {}
        for k, url, html in pages:
            for h in {htmltext.HOST, *(t[0] for t in htmltext.read_page(html, only_trees=True, markup=markup)[1])}:
                gold.setdefault((f"h{k % 2}", h), set()).add(html)
        gold = {x for x, p in gold.items() if len(p) >= htmltext.LEAST_PAGES}
        got = {(r["host"], h) for r in htmltext.page_templates(df, markup=markup).collect() for h in r["templates"]}
        assert got == gold and len(gold) >= 8
    alone = {r["page_id"]: r["text"] for r in htmltext.extract_text(df, markup=False).collect()}
    # counts alone: menus, footers and adverts go, whose shapes recur, though an advert's words are on fewer than five pages of a host
    assert all(alone[k] == f"Story {k}" for k in range(60))


def test_forest_tells_planted_secrets_in_held_out_documents(spark):
    from .test_corpus import docs_of

    r = random.Random(8)
    voc = "the house tree water people morning evening garden winter summer market street".split()
    docs = docs_of(spark, [" ".join(r.choice(voc) for _ in range(60)) for _ in range(3000)])
    words = secretscan.dictionary(docs)
    made = secretscan.planted(docs)
    found = secretscan.features(secretscan.findings(made), words).join(made.select("doc_id", "label"), "doc_id").filter(is_held_out("doc_id.doc_id"))
    rows = secretscan.with_score(found, secretscan.train(docs, words)).select("label", "score").collect()
    hit = sum(x["label"] == 1 and x["score"] >= 0.5 for x in rows)
    planted = made.filter(is_held_out("doc_id.doc_id")).filter("label = 1").count()
    assert planted > 200 and hit >= 0.9 * planted and hit >= 0.95 * sum(x["score"] >= 0.5 for x in rows)
    assert len({x["score"] for x in rows}) > 10
