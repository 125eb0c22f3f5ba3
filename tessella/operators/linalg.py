"""Matrices in long form (i, j, v): dense, and sparse where zeros are absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def eye(spark: SparkSession, n: int, m: int | None = None, k: int = 0) -> DataFrame:
    """Ones on diagonal k; zeros are absent."""
    cols = n if m is None else m
    return spark.range(n).select(F.col("id").alias("i"), (F.col("id") + k).alias("j"), F.lit(1.0).alias("v")).where((F.col("j") >= 0) & (F.col("j") < cols))


def from_rows(df: DataFrame, row: str, values: str) -> DataFrame:
    return df.select(F.col(row).alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long"), F.col("v").cast("double").alias("v"))


def to_rows(m: DataFrame, width: int) -> DataFrame:
    """(i, values): a dense array a row; the width must fit one executor."""
    cells = F.map_from_entries(F.collect_list(F.struct("j", "v")))
    return m.groupBy("i").agg(cells.alias("__m")).select("i", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda j: F.coalesce(F.col("__m")[j], F.lit(0.0))).alias("values"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def tril(m: DataFrame, k: int = 0) -> DataFrame:
    return m.where(F.col("j") <= F.col("i") + k)


def triu(m: DataFrame, k: int = 0) -> DataFrame:
    return m.where(F.col("j") >= F.col("i") + k)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """A join on the inner index and a sum with partial aggregation; zeros never meet."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def gram(df: DataFrame, row: str, values: str) -> DataFrame:
    """Columns by columns product of a tall matrix of arrays: each row gives its own products, no join."""
    pairs = df.select(F.posexplode(values).alias("i", "x"), F.col(values).alias("__v")).select("i", "x", F.posexplode("__v").alias("j", "y"))
    return pairs.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("v"))


def dot(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias("dot"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def scale(m: DataFrame, by: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * by)


def nonzero(m: DataFrame) -> DataFrame:
    return m.where(F.col("v") != 0)


def csr(m: DataFrame) -> DataFrame:
    """(i, start, cols, vals): compressed rows; start counts the entries of the rows before."""
    from tessella.operators.position import running

    rows = m.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("__e"))
    rows = rows.select("i", F.transform("__e", lambda e: e["j"]).alias("cols"), F.transform("__e", lambda e: e["v"]).alias("vals"))
    return running(rows, ["i"], F.size("cols"), "start").withColumn("start", F.col("start") - F.size("cols"))


def random_sparse(spark: SparkSession, n: int, density: float, seed: int = 0) -> DataFrame:
    """density * n * n entries of uniform values at distinct places: the matrix, read by rows, is cut into as many parts, each with one entry."""
    from tessella.operators.random import unit

    k = round(n * n * min(max(density, 0.0), 1.0))
    place = F.floor((F.col("id") + unit(F.col("id"), seed)) * (n * n / max(k, 1))).cast("decimal(38,0)")  # one cell of each k-th part of the matrix
    cells = spark.range(k).select("id", F.least(place, F.lit(n * n - 1).cast("decimal(38,0)")).alias("__c"))
    return cells.select(F.floor(F.col("__c") / n).cast("long").alias("i"), (F.col("__c") % n).cast("long").alias("j"), unit(F.col("id"), seed, 1).alias("v"))
