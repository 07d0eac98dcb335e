"""Tables that are written once in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_kept: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a new one in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; the innermost ``scope`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _kept:
        _kept[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    The lineage is cut and a lost executor costs only a re-read; readers prune columns.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables, in whatever store they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more."""
    for t in tables:
        remove(t.sparkSession, t._staged_at)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all tables that were staged inside; results must have been written by then."""
    _kept.append([])
    try:
        yield
    finally:
        remove(spark, *_kept.pop())
