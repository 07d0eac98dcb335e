"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it
returns is written as Parquet in the shared folder and read again as the next stage's documents.

Cases, as the operators have them: documents with a null or empty text fail the quality rules, so none
goes on; very long texts are worked on whole; equal rows are copies, of which one stays; in ties the smallest id stays; an
empty table gives an empty table; further columns go through all stages, whatever their names
(``n_chars`` follows a cut text, ``shard`` is replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import decontam, mixing, neardup, quality, shard
from loomgrid.llm.common import small_batches
from loomgrid.staging import new_path, remove, scope


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language's distributions."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8)."""
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of the benchmark; contaminated ones lose those spans."""
    return decontam.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their shard, 0 to 39."""
    return shard.shard_documents(docs, 40)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shards)]

#: No SQL: the cuts of the K-d tree and the search for passages aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Tables of a stage go once its documents are written, and these once the next stage's are; what the last stage reads stays."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        remove(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
