"""Operators on row position.

Position is an explicit column. Where a whole table has to be numbered, a
two-level scan is used (rows are counted by range partition, then numbered
within it), so no operator here gathers a table in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut


def _columns(order: Sequence) -> list[Column]:
    return [x if isinstance(x, Column) else F.col(x) for x in order]


def with_position(df: DataFrame, order: Sequence, out: str = "pos", partitions: int | None = None) -> DataFrame:
    """Number the rows from 0 in the given (total) order.

    Rows are sorted by range and written once (range limits are sampled, so
    they must not be drawn twice); each range is counted, and a row's number is
    its place in its range plus the sizes of the ranges before.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *_columns(order)).sortWithinPartitions(*_columns(order)).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    ranged = cut(ranged, "position")
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "__first", "__before")
    return ranged.join(F.broadcast(before), "__p").withColumn(out, F.col("__m") - F.col("__first") + F.col("__before")).drop("__p", "__m", "__first", "__before")


def argsort(df: DataFrame, by: Sequence, pos: str = "pos", out: str = "rank") -> DataFrame:
    """(rank, pos): the permutation that sorts stably by the given columns."""
    return with_position(df, [*_columns(by), F.col(pos)], out).select(out, pos)


def invert_permutation(df: DataFrame, index: str = "rank", pos: str = "pos") -> DataFrame:
    return df.select(F.col(pos).alias(index), F.col(index).alias(pos))


def gather(df: DataFrame, indices: DataFrame, pos: str = "pos", index: str = "index") -> DataFrame:
    """The rows of ``df`` at the given positions, once for each time asked."""
    return indices.join(df, indices[index] == df[pos])


def scatter(df: DataFrame, updates: DataFrame, value: str, pos: str = "pos", new: str = "new") -> DataFrame:
    """Overwrite ``value`` where ``updates`` (pos, new) has a row for the position."""
    return df.join(updates, pos, "left").withColumn(value, F.when(F.col(new).isNotNull(), F.col(new)).otherwise(F.col(value))).drop(new)


def searchsorted(df: DataFrame, values: DataFrame, column: str, value: str, side: str = "left") -> DataFrame:
    """(value, slot): how many elements of the column lie before each distinct value.

    Equal elements are counted first, so a frequent one is a single row; then
    one sort of both together and a two-level running count, no pair of rows is
    ever formed.
    """
    both = df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__one")).select("__v", F.lit(1 if side == "left" else 0).alias("__k"), "__one").unionByName(
        values.select(F.col(value).alias("__v"), F.lit(0 if side == "left" else 1).alias("__k"), F.lit(0).cast("long").alias("__one")).distinct()
    )
    counted = running(both, ["__v", "__k"], F.col("__one"), "slot")
    return counted.where("__one = 0").select(F.col("__v").alias(value), "slot")


def running(df: DataFrame, order: Sequence, value: Column, out: str, function: str = "sum", partition_by: Sequence[str] = ()) -> DataFrame:
    """A running sum, product (by logarithms and signs), minimum or maximum.

    With ``partition_by`` a window does it. Without, the table is cut into
    ranges, whose totals are carried on.
    """
    if partition_by:
        agg = RUNNING[function]
        return df.withColumn(out, agg(value).over(Window.partitionBy(*partition_by).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)))
    return running_values(df, order, {out: (function, value)})


RUNNING = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product}


def running_values(df: DataFrame, order: Sequence, asked: dict[str, tuple[str, Column]]) -> DataFrame:
    """Several running values (output -> function, value) in one pass: one sort by range, one table of the ranges' totals."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = [(i, out, function, RUNNING[function]) for i, (out, (function, _)) in enumerate(asked.items())]
    ranged = df.withColumns({f"__x{i}": value for i, (_, value) in enumerate(asked.values())}).repartitionByRange(n, *_columns(order)).withColumn("__p", F.spark_partition_id())
    ranged = cut(ranged, "running")
    totals = ranged.groupBy("__p").agg(*[agg(f"__x{i}").alias(f"__t{i}") for i, _, _, agg in kinds])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("__p", *[agg(f"__t{i}").over(before).alias(f"__c{i}") for i, _, _, agg in kinds])
    inside = Window.partitionBy("__p").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    met = ranged.withColumns({f"__own{i}": agg(f"__x{i}").over(inside) for i, _, _, agg in kinds}).join(F.broadcast(carry), "__p")

    def joined(i: int, function: str) -> Column:
        own, before = F.col(f"__own{i}"), F.col(f"__c{i}")
        return {"sum": own + F.coalesce(before, F.lit(0)), "product": own * F.coalesce(before, F.lit(1.0)), "min": F.least(own, before), "max": F.greatest(own, before)}[function]

    return met.withColumns({out: joined(i, function) for i, out, function, _ in kinds}).drop("__p", *[f"__{x}{i}" for i, *_ in kinds for x in ("x", "own", "c")])


def diff(df: DataFrame, order: Sequence, value: str, out: str = "diff", partition_by: Sequence[str] = ()) -> DataFrame:
    """Difference to the row before; NULL for the first (of each group)."""
    if partition_by:
        return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*partition_by).orderBy(*_columns(order))))
    numbered = with_position(df, order, "__pos")
    before = numbered.select((F.col("__pos") + 1).alias("__pos"), F.col(value).alias("__before"))
    return numbered.join(before, "__pos", "left").withColumn(out, F.col(value) - F.col("__before")).drop("__pos", "__before")


def shift(df: DataFrame, order: Sequence, value: str, by: int = 1, out: str = "shifted", wrap: bool = False) -> DataFrame:
    """The value ``by`` rows before; with ``wrap`` the table is a ring (roll)."""
    numbered = with_position(df, order, "__pos")
    at = F.col("__pos") + by
    moved = numbered.select((F.pmod(at, F.lit(numbered.count())) if wrap else at).alias("__pos"), F.col(value).alias(out))
    return numbered.join(moved, "__pos", "left").drop("__pos")


def is_sorted(df: DataFrame, order: Sequence, value: str) -> DataFrame:
    """One row: whether the value never falls in the given order."""
    return diff(df, order, value, "__d").agg((F.coalesce(F.min("__d"), F.lit(0)) >= 0).alias("is_sorted"))


def top_k(df: DataFrame, column: str, k: int, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The k smallest or largest; each task keeps k rows only."""
    return df.orderBy(F.desc(column) if largest else F.asc(column), *ties).limit(k)


def tail(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.desc(x) for x in order]).limit(n).orderBy(*order)


def repeat(df: DataFrame, times) -> DataFrame:
    """Every row ``times`` times, numbered from 0 in ``copy``."""
    n = times if isinstance(times, Column) else F.lit(times)
    return df.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))


def generate_ranges(df: DataFrame, start: str, end: str, out: str = "value", stride: int = 1) -> DataFrame:
    """All integers start, start + stride, ... below end, a row each."""
    last = F.col(end) - 1
    return df.withColumn(out, F.explode(F.when(last >= F.col(start), F.sequence(F.col(start), last, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))))
