"""Secret scan with a random forest that removes false positives, in DataFrame operations only.

Candidates are long strings with digits, and values that are assigned to a name of a credential,
in the same word or in the words before it; a word can hold any number of them (a name inside a value names nothing more).
Each has features of its length, characters, transitions between character classes, entropy, how
much of it the corpus's common short words cover, path-like marks, and the words beside it. The
forest (Spark ML, in the JVM) is trained on labelled findings: those given, and planted ones. A planted
finding is a secret or a harmless look-alike of a known kind (``planted``), made of a digest and put between words of a
document; its label is what was put there, not a function of the features. Neither kind is
learned from in documents whose crc32(doc_id as text) mod 4 is 2, so those measure precision and recall.

Cases: a null or empty text has no findings; repeated rows give repeated findings; where there are no
words to plant findings in and none are given, or all are of one kind, every score is 0.5; ties can't arise (part
numbers the candidates of a word); an empty table gives an empty result; a very long text is scanned whole; other columns play no part,
whatever their names. Training rows are bounded by ``PLANTED`` and ``TRAIN_ROWS``; everything else covers all documents.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, staged

#: A run of 16 or more token characters with a digit.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
#: Names of credentials (fixed values), and such a name at the end of a word.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key", "key")
_NAME = "(?i)(?:" + "|".join(NAMES) + r")s?[\"']?"
NAMED = _NAME + "$"
ASSIGNED = _NAME + "[:=]++[\"']?+((?:(?!&[A-Za-z0-9_-]{1,64}=)[^\x20\x09-\x0D\"',;]){8,})"
#: A name with a mark of assignment, also with white space before the mark; and the value at the begin of a word. Marks and a quote before a value are never part of it.
NAMES_ONE, VALUE = _NAME + r"[\x20\x09-\x0D]*[:=]", "^[:=]*+[\"']?+([^\x20\x09-\x0D\"',;]{8,})"
#: Characters of the word on each side of a candidate, and of the words beside it, that features look at.
NEAR = 200
#: Words of the dictionary, their letters; planted and other rows of training; the forest; a secret's least score.
DICTIONARY, PLANTED, MOST_TIMES, TRAIN_ROWS, TREES, DEPTH, SEED, THRESHOLD = 200, 8_000, 16, 20_000, 24, 8, 11, 0.5

FEATURES = ("length", "digits", "uppers", "lowers", "others", "transitions", "distinct", "entropy", "covered", "slashes", "dots", "path_like", "named", "assigned", "quoted", "before_length", "after_length")


def dictionary(docs: DataFrame, words: int = DICTIONARY) -> list[str]:
    """The corpus's most frequent words of 3 to 5 ASCII letters; at most ``words`` come to the driver."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z]{3,5})\b"), 1)).alias("w"))
    return [r["w"] for r in found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()]


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal of the word, part (the candidate's number in it), value, whether it is assigned, and the text around each candidate."""
    hit = docs.select("doc_id", "text").filter(F.col("text").rlike(TOKEN) | F.col("text").rlike(NAMES_ONE))
    words = hit.select("doc_id", F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    near = lambda i, k: F.coalesce(F.try_element_at("w", F.when(i + k >= 1, (i + k).cast("int")).otherwise(F.size("w") + 1)), F.lit(""))
    follows = lambda word, b1, b2: b1.rlike(_NAME + "[:=]+$") | (b1.rlike(NAMED) & word.rlike("^[:=]")) | (b1.rlike("^[:=]+$") & b2.rlike(NAMED))
    at = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: near(i, 0).rlike(TOKEN) | near(i, 0).rlike(ASSIGNED) | (near(i, 0).rlike(VALUE) & follows(near(i, 0), near(i, -1), near(i, -2))))
    # the few words around each place leave the array before its places become rows, so no row carries the array
    around = F.transform(at, lambda i: F.struct(i.cast("long").alias("ordinal"), near(i, 0).alias("word"), near(i, -1).alias("b1"), near(i, -2).alias("b2"), near(i, 1).alias("after")))
    rows = words.select("doc_id", F.inline(around))
    first = F.when(follows(F.col("word"), F.col("b1"), F.col("b2")), F.array(F.regexp_extract("word", VALUE, 1))).otherwise(F.array().cast("array<string>"))
    assigned = F.array_distinct(F.filter(F.concat(first, F.regexp_extract_all("word", F.lit(ASSIGNED), 1)), lambda v: v != ""))
    rows = rows.select("*", assigned.alias("set"), F.array_distinct(F.regexp_extract_all("word", F.lit(TOKEN), 0)).alias("tokens"))
    # a token inside an assigned value isn't one more candidate
    free = F.filter("tokens", lambda t: ~F.exists("set", lambda v: F.contains(v, t)))
    each = lambda values, mark: F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(mark).alias("is_assigned")))
    rows = rows.select("doc_id", "ordinal", "word", *[F.substring(c, -NEAR, NEAR).alias(c) for c in ("b1", "b2")], F.substring("after", 1, NEAR).alias("after"), F.posexplode(F.concat(each(F.col("set"), True), each(free, False))).alias("part", "c"))
    begin = F.greatest(F.instr("word", F.col("c.value")) - NEAR, F.lit(1))
    return rows.select("doc_id", "ordinal", F.col("part").cast("long").alias("part"), "b1", "b2", "after", F.col("c.value").alias("value"), F.col("c.is_assigned").alias("is_assigned"), F.substring("word", begin, F.length("c.value") + 2 * NEAR).alias("word"))


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with one double column per feature."""
    value, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    share = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]+", "\u0001"), "[A-Z]+", "\u0002"), "[a-z]+", "\u0003")
    known = "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")" if words else "(?!)"
    entropy = "aggregate(filter(array_distinct(split(value, '')), c -> c <> ''), 0D, (s, c) -> s - ((length(value) - length(replace(value, c, ''))) / length(value)) * log2((length(value) - length(replace(value, c, ''))) / length(value)))"
    pair = F.concat_ws(" ", "b2", "b1")
    made: dict[str, Column] = {
        "length": F.length(value),
        "digits": share("[^0-9]"), "uppers": share("[^A-Z]"), "lowers": share("[^a-z]"), "others": share("[A-Za-z0-9]"),
        "transitions": F.length(classes) - 1,
        "distinct": F.expr("size(filter(array_distinct(split(value, '')), c -> c <> ''))") / n,
        "entropy": F.expr(entropy),
        "covered": 1 - F.length(F.regexp_replace(F.lower(value), known, "")) / n,
        "slashes": F.length(F.regexp_replace("word", "[^/]", "")), "dots": F.length(F.regexp_replace("word", "[^.]", "")),
        "path_like": F.col("word").rlike(r"^(?:[a-zA-Z]+://|/|\./|~)|\.[a-z]{2,4}$"),
        "named": pair.rlike("(?i)" + "|".join(NAMES)),
        "assigned": F.col("is_assigned"),
        "quoted": F.col("word").rlike("^[\"'].*[\"']|[:=][\"']"),
        "before_length": F.length("b1"), "after_length": F.length("after"),
    }
    return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})


def planted(docs: DataFrame, rows: int = PLANTED) -> DataFrame:
    """(doc_id, text, label): words of about ``rows`` documents with one planted finding each; label 1 is a secret.

    Where documents are fewer, each is taken up to MOST_TIMES times; doc_id holds the document's id and the time.

    Its kind is drawn by a digest of the id. Secrets: keys and tokens with and without a name, passwords, cloud
    keys. Others: identifiers, numbers, paths, addresses, file names, checksums and commits with their
    words before them, made-up names of words, keys of caches, and placeholders.
    """
    draw = lambda k, n: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "time", F.lit(SEED), F.lit(k)), F.lit(n)).cast("int")
    digest = lambda k: F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "time", F.lit(k)), 256)
    chars = lambda k, n: F.substring(F.translate(F.base64(F.unhex(digest(k))), "+/=", "xY7"), 1, n)
    digits = lambda k, n: F.substring(F.regexp_replace(F.concat(digest(k), digest(k + 100)), "[a-f]", ""), 1, n)
    word = lambda k: F.lower(F.get("w", draw(k, 1 << 20) % F.greatest(F.size("w"), F.lit(1))))
    named = F.element_at(F.array(*[F.lit(n) for n in NAMES]), draw(1, len(NAMES)) + 1)
    mark = F.element_at(F.array(*[F.lit(m) for m in ("=", ": ", " = ", ':"', '="')]), draw(2, 5) + 1)
    size = 20 + draw(3, 24)
    uuid = F.regexp_replace(F.substring(digest(4), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    secrets = [
        F.concat(named, mark, chars(5, 43).substr(F.lit(1), size)), F.concat(named, mark, F.substring(digest(6), 1, 40)), F.concat(named, mark, chars(7, 12)), F.concat(F.lit("AKIA"), F.upper(chars(8, 16))),
        chars(9, 40), F.concat(F.lit("ghp_"), chars(10, 36)), F.concat(F.lit("https://"), word(11), F.lit(".com/?"), named, F.lit("="), chars(12, 24)), F.concat(named, mark, F.initcap(word(13)), digits(14, 4), F.lit("!"), chars(15, 5)), F.concat(named, mark, word(50), word(51), digits(52, 1)),
    ]
    others = [
        uuid, digits(16, 16), F.concat(F.lit("/usr/"), word(17), F.lit("/"), word(18), F.lit("-"), digits(19, 4), F.lit("/"), word(20), F.lit(".txt")), F.concat(F.lit("https://"), word(21), F.lit(".com/"), word(22), F.lit("/"), digits(23, 8), F.lit("/"), word(24)),
        F.concat(F.lit("commit "), F.substring(digest(25), 1, 40)), F.concat(F.lit("sha256 checksum "), digest(26)), F.concat(named, mark, F.lit("your_"), word(27), F.lit("_here_"), digits(28, 1)), F.concat(named, mark, word(29), F.lit("_"), word(30), F.lit("_"), word(31)),
        F.concat(F.initcap(word(32)), F.initcap(word(33)), F.initcap(word(34)), F.initcap(word(35)), digits(36, 2)), F.concat(word(37), F.lit("_"), word(38), F.lit("_"), word(39), F.lit("_20"), digits(40, 6), F.lit("-"), digits(41, 6)),
        F.concat(F.lit("id "), digits(42, 4), F.lit("-"), digits(43, 4), F.lit("-"), digits(44, 4), F.lit("-"), digits(45, 4)), F.concat(named, mark, uuid), F.concat(F.lit("cache key"), mark, F.substring(digest(53), 1, 32)),
    ]
    able = docs.filter("doc_id IS NOT NULL AND text <> ''").select("doc_id", "text")
    # by a threshold of the digest, as sorting for the first would send texts to one task
    n = max(able.count(), 1)
    share, times = min(1.0, rows / n), max(1, min(MOST_TIMES, rows // n))
    chosen = able.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # plain words only, so that what is found is what is planted
    plain = chosen.select("doc_id", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w.rlike("^[A-Za-z]{2,12}[.,]?$") & ~w.rlike(NAMED)).alias("all"))
    plain = plain.select("doc_id", F.filter("all", lambda w: w.rlike("^[A-Za-z]+$")).alias("w"), F.slice("all", 1, 30).alias("before"), F.slice("all", 31, 30).alias("after")).filter(F.size("w") > 3)
    plain = plain.withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    is_secret = draw(46, 2) == 1
    piece = F.when(is_secret, F.element_at(F.array(*secrets), draw(47, len(secrets)) + 1)).otherwise(F.element_at(F.array(*others), draw(48, len(others)) + 1))
    return plain.select(F.struct("doc_id", "time").alias("doc_id"), F.concat_ws(" ", F.concat_ws(" ", "before"), piece, F.concat_ws(" ", "after")).alias("text"), is_secret.cast("double").alias("label"))


def train(docs: DataFrame, words: list[str], found: DataFrame | None = None, labelled: DataFrame | None = None) -> PipelineModel | None:
    """The forest from planted findings, and from those of ``found`` that ``labelled`` names; None where all are of one kind."""
    made = staged(planted(docs).repartition("doc_id"), "planted")
    rows = features(findings(made), words).join(made.select("doc_id", "label").dropDuplicates(["doc_id"]), "doc_id").filter(~is_held_out("doc_id.doc_id")).select("label", *FEATURES)
    if labelled is not None:
        key = ["doc_id", "ordinal", *(c for c in labelled.columns if c == "part")]
        known = found.join(labelled.select(*key, F.col("label").cast("double").alias("label")), key).filter(F.col("label").isNotNull() & ~is_held_out())
        rows = rows.union(known.orderBy(F.xxhash64("doc_id", "ordinal"), "value", "part").limit(TRAIN_ROWS).select("label", *FEATURES))
    rows = staged(rows, "train")
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="x"), forest]).fit(rows)


def with_score(found: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``found`` with the forest's score."""
    return found.withColumn("score", F.lit(0.5)) if model is None else model.transform(found).withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, ordinal, part, value_sha256, length, score, secret of every candidate.

    ``labelled`` (doc_id, ordinal, label 0 or 1, and part where a word has several candidates), if given, is learned from, too.
    """
    words = dictionary(docs)
    found = staged(features(findings(docs), words), "findings")
    scored = with_score(found, train(docs, words, found, labelled))
    return scored.select("doc_id", "ordinal", "part", F.sha2("value", 256).alias("value_sha256"), F.col("length").cast("long").alias("length"), "score", (F.col("score") >= THRESHOLD).alias("secret"))
