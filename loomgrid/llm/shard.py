"""Sharding by a K-d tree: leaves of near equal bytes, split at weighted medians.

A node that has to give k leaves is split along its widest metadata dimension at the weighted
quantile floor(k / 2) / k, until each node gives one leaf. Dimensions are text length (log),
source and language (digests of the names), each scaled to [0, 1); a key holds the scaled value in its upper
bits and a digest of the text below. Equal texts are one group with one key: they take the least source and
language value of the group, so they share a shard whatever their sources. Only a group that has more bytes than a leaf is
split, by digests of its rows. All nodes of a level are
split together: their quantiles are found by a few passes of histograms over a slim staged
table, each of which narrows the range 8192 times. The driver sees at most one row per node.

Cases: a null text has no bytes (and no checksum); null source and language are values of
their own; repeated rows are separate rows, told apart by a number; ids of any type; a very long text is one row, and may be more than a shard's share;
an empty table gives an empty result; columns beside doc_id, text, source and lang play no part in the split and are kept by
``shard_documents``, whatever their names (one named ``shard`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, fresh, staged

#: Bytes that a row takes beside its text.
OVERHEAD = 16
#: Bits of a key's value, and of the digests below it: the text's, or in a group that is split fewer of them and the row's.
VALUE_BITS, TEXT_BITS, ROW_BITS = 16, 20, 16
TIE_BITS = TEXT_BITS + ROW_BITS
#: Bits by which one pass of histograms narrows a cut, and rows of a leaf's share that a cut may miss.
STEP_BITS, SLACK = 13, 0.001

DIMENSIONS = ("key_length", "key_source", "key_lang")
#: Blocks of a shard inside which rows are numbered.
BLOCKS = 1024


def size_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the row's overhead."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def _name_value(name: Column) -> Column:
    """A name's place in [0, 1): its digest, so that equal names stay together whatever their number."""
    return F.when(name.isNull(), F.lit(0.999)).otherwise(F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("double") / F.lit(float(16**7)) * 0.998)


#: What names a text: its digest, checksum (-1: null) and size.
TEXT = ("_hash", "_sum", "_size")


def _parts(row: Column) -> list[Column]:
    """The text's name, the row's own values per dimension, and its digest, made of ``doc_id``, ``text``, ``source`` and ``lang``."""
    size = size_bytes(F.col("text"))
    values = {"key_length": F.log2(size.cast("double")) / 24.0, "key_source": _name_value(F.col("source").cast("string")), "key_lang": _name_value(F.col("lang").cast("string"))}
    scaled = [F.least(F.floor(v * (1 << VALUE_BITS)), F.lit((1 << VALUE_BITS) - 1)).cast("long").alias(f"_{k}") for k, v in values.items()]
    digest = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), row), F.lit(1 << ROW_BITS)).alias("_row_digest")
    return [F.xxhash64("text").alias("_hash"), F.coalesce(F.crc32("text"), F.lit(-1).cast("long")).alias("_sum"), size.alias("_size"), *scaled, digest]


def groups_of(slim: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Of the texts that stand more than once: those of several sources or languages with the least value of each, and those with more bytes than a leaf.

    The second table has ``shards`` rows at most.
    """
    source, lang = F.col("_key_source"), F.col("_key_lang")
    texts = staged(
        slim.groupBy(*TEXT).agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_n"), F.min(source).alias("_least_source"), F.min(lang).alias("_least_lang"), ((F.min(source) < F.max(source)) | (F.min(lang) < F.max(lang))).alias("_several")),
        "texts",
    )
    total = texts.agg(F.sum("_bytes")).first()[0] or 0
    several = texts.filter("_n > 1 AND _several").select(*TEXT, "_least_source", "_least_lang")
    return several, texts.filter((F.col("_n") > 1) & (F.col("_bytes") > total / shards)).select(*TEXT, F.lit(True).alias("_split"))


def with_keys(df: DataFrame, groups: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows with ``_parts`` get a long key per dimension: the scaled value above, digests below."""
    several, large = groups
    both = df.join(F.broadcast(large), list(TEXT), "left").join(several, list(TEXT), "left")
    whole = F.pmod("_hash", F.lit(1 << TIE_BITS))
    apart = F.shiftleft(F.pmod("_hash", F.lit(1 << TEXT_BITS)), ROW_BITS) + F.col("_row_digest")
    low = F.when(F.col("_split"), apart).otherwise(whole)
    values = {"key_length": F.col("_key_length"), "key_source": F.coalesce("_least_source", "_key_source"), "key_lang": F.coalesce("_least_lang", "_key_lang")}
    return both.withColumns({k: F.shiftleft(v, TIE_BITS) + low for k, v in values.items()})


def slim_rows(docs: DataFrame, row: Column) -> DataFrame:
    """What the groups and the tree are built on, staged: id, size, checksum, the parts of the keys and a block number that spreads rows evenly."""
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), row, F.lit(1)), F.lit(BLOCKS))
    return staged(docs.select("doc_id", F.crc32("text").alias("text_crc32"), block.alias("block"), *_parts(row)), "kd")


def keyed(slim: DataFrame, groups: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The table that the tree is built on: id, size, checksum, keys and block."""
    return staged(with_keys(slim, groups).select("doc_id", F.col("_size").alias("size"), "text_crc32", "block", *DIMENSIONS), "kd-keys")


class Node:
    """Leaves [first, first + leaves) of the tree, and its cut once that is known."""

    def __init__(self, first: int, leaves: int) -> None:
        self.first, self.leaves, self.cut = first, leaves, None

    def expression(self) -> Column:
        """The leaf (or first leaf of an uncut node) that a row belongs to."""
        if self.cut is None:
            return F.lit(self.first)
        dim, at, left, right = self.cut
        return F.when(F.col(dim) < F.lit(at), left.expression()).otherwise(right.expression())

    def open(self) -> list[Node]:
        if self.cut is None:
            return [self] if self.leaves > 1 else []
        return [n for x in self.cut[2:] for n in x.open()]


def _widest(rows: DataFrame) -> dict[int, tuple[str, int, int, int]]:
    """For each node its widest dimension with the least and greatest key, and its bytes."""
    got = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]).collect()
    out = {}
    for r in got:
        # the first of equally wide dimensions; at VALUE_BITS, as the digest below only breaks ties
        dim = max(DIMENSIONS, key=lambda d: ((r[f"{d}_max"] >> TIE_BITS) - (r[f"{d}_min"] >> TIE_BITS), -DIMENSIONS.index(d)))
        out[r["node"]] = (dim, r[f"{dim}_min"], r[f"{dim}_max"], r["bytes"])
    return out


def build_tree(rows: DataFrame, shards: int, slack: float = SLACK) -> Node:
    """The tree over a table of ``keyed`` rows."""
    root = Node(0, shards)
    while nodes := root.open():
        here = rows.withColumn("node", root.expression()).filter(F.col("node").isin([n.first for n in nodes]))
        wide = _widest(here)
        # an uncut node without rows is cut at 0: its leaves stay empty
        state = {n.first: [*wide.get(n.first, (DIMENSIONS[0], 0, 0, 0)), 0] for n in nodes}  # dim, lo, hi, bytes, bytes below lo
        goal = {n.first: state[n.first][3] * (n.leaves // 2) / n.leaves for n in nodes}
        mean = {n.first: state[n.first][3] / n.leaves for n in nodes}
        cuts: dict[int, int] = {n.first: 0 for n in nodes if n.first not in wide}
        while todo := [k for k in state if k not in cuts]:
            shift = {k: max(0, (state[k][2] - state[k][1]).bit_length() - STEP_BITS) for k in todo}
            # one row per open node, at most as many as shards
            facts = [(k, DIMENSIONS.index(state[k][0]), state[k][1], state[k][2], shift[k], float(goal[k] - state[k][4])) for k in todo]
            open_nodes = F.broadcast(rows.sparkSession.createDataFrame(facts, "node int, dim int, low long, high long, shift int, need double"))
            key = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
            bins = (
                here.join(open_nodes, "node").withColumn("key", key).filter(F.col("key").between(F.col("low"), F.col("high")))
                .groupBy("node", "need", F.expr("shiftright(key - low, shift)").alias("bin")).agg(F.sum("size").alias("bytes"))
                .withColumn("upto", F.sum("bytes").over(Window.partitionBy("node").orderBy("bin")))
            )
            # the bin in which the goal is reached: at most 2**STEP_BITS bins a node, one row a node comes back
            found = bins.filter("upto >= need").groupBy("node").agg(F.min(F.struct("bin", "bytes", "upto")).alias("b")).collect()
            for r in found:
                k, b = r["node"], r["b"]
                lo = state[k][1] + (b["bin"] << shift[k])
                below, width = state[k][4] + b["upto"] - b["bytes"], 1 << shift[k]
                if b["bytes"] <= slack * mean[k] or shift[k] == 0:
                    # the nearer edge of the bin
                    over = below + b["bytes"] - goal[k]
                    cuts[k] = lo + width if over <= goal[k] - below else lo
                else:
                    state[k][1], state[k][2], state[k][4] = lo, min(state[k][2], lo + width - 1), below
            for k in set(todo) - {r["node"] for r in found}:
                cuts[k] = state[k][2] + 1
        for n in nodes:
            left = n.leaves // 2
            n.cut = (state[n.first][0], cuts[n.first], Node(n.first, left), Node(n.first + left, n.leaves - left))
    return root


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (0, 1, ... without gaps in each shard) of every row."""
    slim = slim_rows(docs, F.monotonically_increasing_id())
    rows = keyed(slim, groups_of(slim, shards))
    placed = rows.withColumn("shard", build_tree(rows, shards).expression())
    # slots: a shard's rows fall into blocks by digest; offsets are the counts of the blocks before
    placed = placed.select("doc_id", "size", "text_crc32", "shard", "block")
    before = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    return placed.withColumn("k", inside).join(before.select("shard", "block", "before"), ["shard", "block"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("k") - 1).cast("long").alias("slot"))


def shards_for(docs: DataFrame, target_bytes: int) -> int:
    """Number of leaves that reach a target size."""
    total = docs.agg(F.sum(size_bytes(F.col("text")))).first()[0] or 0
    return max(1, -(-total // target_bytes))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` with all its columns and the shard of each row.

    Rows are numbered in a staged copy, so that the tree and the result see the same numbers.
    """
    row = fresh(docs, "_row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    slim = slim_rows(numbered, F.col(f"`{row}`"))
    groups = groups_of(slim, shards)
    tree = build_tree(keyed(slim, groups), shards)
    # keys are made beside the row, so that no name can clash; texts of several sources join by Spark's own size check
    made = with_keys(numbered.select(F.struct(*columns_of(docs)).alias("row"), *_parts(F.col(f"`{row}`"))), groups)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "shard"]
    return made.select(*kept, tree.expression().cast("int").alias("shard"))
