"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmltext, importance, langid, mixing, neardup, quality, secretscan, shard, topk, toxicity, warc, whitening
from .common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    out = shard.assign_shards(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labels that aren't held out."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    archives = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, with_text=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op5_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret in all documents, with the forest's score."""
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def op9_template_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract_text(_table(spark, sf_dir, "pages"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the divergence verdict of every document."""
    out = quality.judge_quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document over two-word shingles at a similarity of 0.8."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold passages of the benchmark."""
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 1.5 times all words takes of every document."""
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest other vectors of every fiftieth, by integer inner product."""
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op12_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the 32 leading components, whitened."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 32)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by how much their words are the benchmark's."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_kd_shards, op2_byte_network_language, op3_weak_toxicity, op4_zstd_warc, op5_forest_secrets, op6_divergence_rules, op7_near_duplicates, op8_fm_decontamination, op9_template_free_text, op10_systematic_mix, op11_maxscore_topk, op12_spectrum_whitening, op13_importance_resampling)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op4_zstd_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
y AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM y
""",
    "op6_divergence_rules": r"""
WITH d AS (SELECT doc_id, lang IS NOT NULL AS known, coalesce('s' || lang, 'null') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, known, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
lines AS (
  SELECT doc_id, CAST(count(*) - count(DISTINCT x) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), win AS (SELECT doc_id, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, a, b, c) AS m FROM win) WHERE m > 1
  ) GROUP BY doc_id
), lt AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS total, CASE WHEN NOT any_value(known) THEN 0 WHEN count(*) FILTER (len(w) > 0) >= 10 AND sum(len(w)) >= 1000 THEN 2 ELSE 1 END AS level
  FROM w GROUP BY lang HAVING sum(len(w)) > 0
), l AS (SELECT lang, total FROM lt WHERE level = (SELECT max(level) FROM lt)),
cls AS (
  SELECT doc_id, lang, unnest(range(7)) AS k, unnest([
    length(regexp_replace(t, '[^a-z]', '', 'g')), length(regexp_replace(t, '[^A-Z]', '', 'g')), length(regexp_replace(t, '[^0-9]', '', 'g')),
    length(regexp_replace(t, '[^.,;:''"?()-]', '', 'g')), length(regexp_replace(t, '[^\x00-\x7F]|[a-zA-Z0-9.,;:''"?()\x20\x09-\x0D-]', '', 'g')),
    length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')), length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))]) AS n FROM d
), q AS (SELECT lang, k, n / sum(n) OVER (PARTITION BY lang) AS q FROM (SELECT lang, k, sum(n) AS n FROM cls JOIN l USING (lang) GROUP BY lang, k)),
p AS (SELECT doc_id, k, n / greatest(sum(n) OVER (PARTITION BY doc_id), 1) AS p FROM cls),
cd AS (
  SELECT doc_id, q.lang, sqrt(least(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0), 1)) AS d
  FROM p JOIN q USING (k) GROUP BY doc_id, q.lang
), sw AS (SELECT doc_id, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM w),
sn AS (SELECT lang, x, count(*) AS n FROM sw JOIN l USING (lang) GROUP BY lang, x),
top AS (SELECT lang, x, n FROM sn JOIN l USING (lang) WHERE 2000 * n >= total QUALIFY count(*) OVER (PARTITION BY lang ORDER BY n DESC) <= 40),
refs AS (SELECT lang, x, n / total AS q FROM top JOIN l USING (lang)),
m AS (SELECT l.lang, coalesce(sum(q), 0) AS mass FROM l LEFT JOIN refs ON refs.lang = l.lang GROUP BY l.lang),
dn AS (SELECT doc_id, x, count(*) AS n FROM sw WHERE x IN (SELECT x FROM refs) GROUP BY doc_id, x),
each AS (
  SELECT w.doc_id, r.lang, greatest(len(w.w), 1) AS nw, r.q, coalesce(dn.n, 0) AS n FROM w CROSS JOIN refs r LEFT JOIN dn ON dn.doc_id = w.doc_id AND dn.x = r.x
), bins AS (
  SELECT doc_id, lang, n / nw AS p, q FROM each
  UNION ALL SELECT doc_id, lang, 1 - sum(n) / max(nw), 1 - sum(q) FROM each GROUP BY doc_id, lang
), wl AS (
  SELECT doc_id, lang, sqrt(least(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0), 1)) AS d FROM bins GROUP BY doc_id, lang
), wd AS (
  SELECT cd.doc_id, min(CASE WHEN mass >= 0.1 THEN wl.d / sqrt((mass + log2(2 / (2 - mass)) + CASE WHEN mass < 1 THEN (1 - mass) * log2(2 * (1 - mass) / (2 - mass)) ELSE 0 END) / 2) WHEN cd.d <= 0.22 THEN 0 END) AS d
  FROM cd JOIN m ON m.lang = cd.lang LEFT JOIN wl ON wl.doc_id = cd.doc_id AND wl.lang = cd.lang GROUP BY cd.doc_id
), n AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    c.d AS cd, coalesce(wd.d, 1) AS wd
  FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(d) AS d FROM cd GROUP BY doc_id) c ON c.doc_id = w.doc_id LEFT JOIN wd ON wd.doc_id = w.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= 20 AND cd > 0.22 OR n_words >= 80 AND wd > 0.95) AS kept FROM f
""",
    "op7_near_duplicates": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS x FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * shared >= 80 * (m.n + o.n - shared)
), e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
""",
    "op8_fm_decontamination": f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[k : k + least(len(w), 13) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)
), m AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS x
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, m WHERE len(w) >= m)
), o AS (SELECT doc_id, k, dw.m, item_id FROM dw JOIN iw ON iw.m = dw.m AND iw.x = dw.x),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
""",
    "op10_systematic_mix": """
WITH x AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 3) AS h, text FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM x GROUP BY source
), c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), v AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level <= cap / w),
g AS (SELECT source, source_size, CAST(least(cap, coalesce(v.level * w, cap)) AS DOUBLE) AS target FROM c, v),
r AS (
  SELECT x.doc_id, x.source, x.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 2.0) ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY x.source ORDER BY x.size, x.h, x.doc_id NULLS LAST) AS k,
    CAST('0x' || substr(md5('7:' || coalesce('s' || x.source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST((floor(k * rate + u) - floor((k - 1) * rate + u)) * size AS BIGINT) AS taken FROM r
""",
    "op11_maxscore_topk": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
    "op13_importance_resampling": f"""
WITH RECURSIVE crc AS (
  SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc WHERE k < 8
), tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS x FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS x FROM benchmark),
words AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM dw UNION SELECT x FROM bw)),
b AS (
  SELECT x, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
    lambda c, y: xor(t[1 + xor(c, y) % 256], c // 256)), 4294967295) % 10000 AS bucket FROM words, tab
), s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (x) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE + 10000 AS s, (SELECT count(*) FROM bw)::DOUBLE + 10000 AS t),
g AS (SELECT s.bucket, CAST(floor(1000 * ln(((coalesce(t.t, 0) + 1) * n.s) / ((s.s + 1) * n.t))) AS BIGINT) AS g FROM s LEFT JOIN t ON t.bucket = s.bucket CROSS JOIN n),
m AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(g) AS BIGINT) AS g FROM dw JOIN b USING (x) JOIN g USING (bucket) GROUP BY doc_id),
w AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce((g - (g % n + n) % n) // n, 0) AS weight FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
c AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM w
), r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, 10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS most FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= most THEN k END AS rank FROM r
""",
}
