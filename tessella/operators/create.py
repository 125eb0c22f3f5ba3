"""Array construction: tables (pos, value) made in the executors, and reshaping them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def full(spark: SparkSession, n: int, value) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pos"), F.lit(value).alias("value"))


def zeros(spark: SparkSession, n: int) -> DataFrame:
    return full(spark, n, 0.0)


def ones(spark: SparkSession, n: int) -> DataFrame:
    return full(spark, n, 1.0)


def arange(spark: SparkSession, start: int, stop: int | None = None, stride: int = 1) -> DataFrame:
    start, stop = (0, start) if stop is None else (start, stop)
    n = max(0, -((start - stop) // stride))
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * stride + start).alias("value"))


def linspace(spark: SparkSession, start: float, stop: float, n: int, endpoint: bool = True) -> DataFrame:
    step = (stop - start) / max(1, n - 1 if endpoint else n)
    return spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * step + start).alias("value"))


def logspace(spark: SparkSession, start: float, stop: float, n: int, base: float = 10.0) -> DataFrame:
    return linspace(spark, start, stop, n).withColumn("value", F.pow(F.lit(base), F.col("value")))


def array(spark: SparkSession, values: Sequence) -> DataFrame:
    """A small list from the driver."""
    return spark.createDataFrame(list(enumerate(values)), ["pos", "value"])


def flip(df: DataFrame, n: int | None = None) -> DataFrame:
    n = df.count() if n is None else n
    return df.withColumn("pos", F.lit(n - 1) - F.col("pos"))


def tile(df: DataFrame, times: int, n: int | None = None) -> DataFrame:
    n = df.count() if n is None else n
    return df.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("pos", F.col("pos") + F.col("__t") * n).drop("__t")


def hstack(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b.withColumn("pos", F.col("pos") + a.count()))


def vstack(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.withColumn("row", F.lit(0)).unionByName(b.withColumn("row", F.lit(1)))


def delete(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Drop positions (a short list) and close the gaps."""
    gone = sorted(set(positions))
    before = sum((F.when(F.col("pos") > p, 1).otherwise(0) for p in gone), F.lit(0))
    return df.where(~F.col("pos").isin(gone)).withColumn("pos", F.col("pos") - before)


def reshape(df: DataFrame, width: int) -> DataFrame:
    return df.select(F.call_function("div", F.col("pos"), F.lit(width)).alias("i"), (F.col("pos") % width).alias("j"), F.col("value").alias("v"))


def ravel(m: DataFrame, width: int) -> DataFrame:
    return m.select((F.col("i") * width + F.col("j")).alias("pos"), F.col("v").alias("value"))


def broadcast_to(df: DataFrame, rows: int) -> DataFrame:
    """A vector repeated as the rows of a matrix."""
    return df.select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), F.col("pos").alias("j"), F.col("value").alias("v"))


def broadcast_shapes(*shapes: Sequence[int]) -> tuple[int, ...]:
    out: list[int] = []
    for i in range(max(map(len, shapes), default=0)):
        sizes = {s[-1 - i] for s in shapes if len(s) > i} - {1}
        if len(sizes) > 1:
            raise ValueError("shapes do not fit")
        out.append(sizes.pop() if sizes else 1)
    return tuple(reversed(out))
