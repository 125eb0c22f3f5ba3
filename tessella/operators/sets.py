"""Set operations on one or more columns, in the order of the values."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unique(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def setxor(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in one of the two only: one aggregation over both, instead of two anti-joins."""
    from pyspark.sql import functions as F

    names = a.columns
    both = a.distinct().withColumn("__s", F.lit(1)).union(b.distinct().withColumn("__s", F.lit(2)))
    return both.groupBy(*names).agg(F.sum("__s").alias("__s")).where("__s < 3").drop("__s")


def drop_duplicates(df: DataFrame, subset: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One whole row a key: the first or last in the given order, found by aggregation."""
    from pyspark.sql import functions as F

    row, at = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)
    best = F.min_by(row, at) if keep == "first" else F.max_by(row, at)
    return df.groupBy(*subset).agg(best.alias("__row")).select("__row.*")


def concatenate(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).count().withColumnRenamed("count", "n")
