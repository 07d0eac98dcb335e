"""Tensors made of the star-schema tables, with whole-number values so that sums are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tensor import VAL, Tensor, tensor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def quantity(spark: SparkSession, sf_dir: str) -> Tensor:
    """B(i, k): quantity by supplier and part."""
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("k")).agg(F.sum(F.col("l_quantity").cast("long")).alias(VAL))
    return Tensor(df, ("i", "k"), (_rows(spark, sf_dir, "supplier"), _rows(spark, sf_dir, "part")))


def lines(spark: SparkSession, sf_dir: str) -> Tensor:
    """C(k, j): line numbers summed by part and supplier."""
    df = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("k"), F.col("l_suppkey").cast("long").alias("j")).agg(F.sum(F.col("l_linenumber").cast("long")).alias(VAL))
    return Tensor(df, ("k", "j"), (_rows(spark, sf_dir, "part"), _rows(spark, sf_dir, "supplier")))


def returned(spark: SparkSession, sf_dir: str) -> Tensor:
    """A(i, k): minus the quantity of returned lines by supplier and part, so that sums with B can cancel."""
    df = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_suppkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("k")).agg((-F.sum(F.col("l_quantity").cast("long"))).alias(VAL))
    return Tensor(df, ("i", "k"), (_rows(spark, sf_dir, "supplier"), _rows(spark, sf_dir, "part")))


def orders3(spark: SparkSession, sf_dir: str, flag: str | None = None) -> Tensor:
    """B3(i, k, l): quantity by customer, part and supplier."""
    items = table(spark, sf_dir, "lineitem")
    items = items.filter(F.col("l_returnflag") == flag) if flag else items
    df = items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").cast("long").alias("i"), F.col("l_partkey").cast("long").alias("k"), F.col("l_suppkey").cast("long").alias("l")).agg(F.sum(F.col("l_quantity").cast("long")).alias(VAL))
    return Tensor(df, ("i", "k", "l"), (_rows(spark, sf_dir, "customer"), _rows(spark, sf_dir, "part"), _rows(spark, sf_dir, "supplier")))


def balances(spark: SparkSession, sf_dir: str) -> Tensor:
    """b(i): whole account balance of each supplier."""
    return tensor(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "i"), ["i"], F.floor("s_acctbal").cast("long"), (_rows(spark, sf_dir, "supplier"),))


def sizes(spark: SparkSession, sf_dir: str) -> Tensor:
    """d(k): size of each part."""
    return tensor(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "k"), ["k"], F.col("p_size").cast("long"), (_rows(spark, sf_dir, "part"),))


def months(spark: SparkSession, sf_dir: str) -> Tensor:
    """M(i, j): orders by the customer's nation and the month."""
    df = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("i"), F.month("o_orderdate").cast("long").alias("j")).agg(F.count(F.lit(1)).alias(VAL))
    return Tensor(df, ("i", "j"), (_rows(spark, sf_dir, "nation"), 13))


def embedding(spark: SparkSession, sf_dir: str) -> Tensor:
    """E(i, k), dense: floor(1000 x) of the embeddings, without rows that lack one."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.posexplode("embedding").alias("k", "x"))
    return tensor(df, ["i", "k"], F.floor(F.col("x").cast("double") * 1000).cast("long"))


def orders_with(spark: SparkSession, sf_dir: str, flag: str) -> Tensor:
    """u(i): orders that have lines of a return flag; the value is the number of such lines. All lines are read."""
    lines_of = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("i")).agg(F.count_if(F.col("l_returnflag") == flag).alias(VAL))
    return Tensor(lines_of.filter(F.col(VAL) > 0), ("i",), (_rows(spark, sf_dir, "orders"),))


def pairs(spark: SparkSession, sf_dir: str) -> Tensor:
    """G(i, j): quantity by supplier and part, both modulo the number of embeddings, as a mask over pairs of these."""
    n = _rows(spark, sf_dir, "embeddings")
    at = lambda c: F.pmod(F.col(c).cast("long"), F.lit(n))
    df = table(spark, sf_dir, "lineitem").groupBy(at("l_suppkey").alias("i"), at("l_partkey").alias("j")).agg(F.sum(F.col("l_quantity").cast("long")).alias(VAL))
    return Tensor(df, ("i", "j"), (n, n))
