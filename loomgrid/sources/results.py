"""Tables of benchmark results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .coordinates import numbered_lines

UNWANTED, FLATTENED = ("group", "params", "options"), ("extra_info", "stats")


def aggregate_csv(spark: SparkSession, path: str, preamble: int = 0) -> DataFrame:
    """All rows of result files with the file they came from; ``preamble`` lines before each header are dropped (10 for one kind of runner).

    A file that ends before its header gives no rows. The header is that of the first file.
    """
    lines = numbered_lines(spark, path)
    # result files are small: a file's lines are numbered among themselves
    k = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    kept = lines.withColumn("k", k).filter(F.col("k") >= preamble)
    head = kept.filter(F.col("k") == preamble).orderBy("file").select("value").first()
    if head is None:
        return spark.createDataFrame([], "original_filename string")
    names = [c.strip().strip('"') for c in head["value"].split(",")]
    rows = kept.filter((F.col("k") > preamble) & (F.trim("value") != "")).select("file", F.from_csv("value", ", ".join(f"`{n}` string" for n in names)).alias("r"))
    return rows.select("r.*", F.col("file").alias("original_filename"))


def bench_json_to_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per benchmark of JSON result files: unwanted keys dropped, ``extra_info`` and ``stats`` flattened; empty files are skipped."""
    read = spark.read.option("multiLine", True).json(path)
    if "benchmarks" not in read.columns:
        return spark.createDataFrame([], "name string")
    rows = read.select(F.explode("benchmarks").alias("b")).select("b.*")
    kinds = {f.name: f.dataType for f in rows.schema}
    out = []
    for name, kind in kinds.items():
        if name in UNWANTED:
            continue
        if name in FLATTENED and isinstance(kind, T.StructType):
            out += [F.col(f"{name}.{f.name}").alias(f.name) for f in kind]
        else:
            out.append(F.col(f"`{name}`"))
    return rows.select(*out)
