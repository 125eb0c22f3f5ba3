"""Grouped and whole-table reductions.

All reductions asked for at once run in one aggregation, but for those that look
at distinct values (``BY_VALUE``) in groups: there equal values of a group are
counted first, column by column, so that a hot group is spread by value. Missing means NULL or
NaN: both are skipped where ``skipna``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.math import NAN


#: Reductions of counted values.
BY_VALUE = ("median", "nunique", "unique", "mode")


def _value(name: str, df: DataFrame, skipna: bool) -> Column:
    c = F.col(name)
    return F.when(~F.isnan(c), c) if skipna and dict(df.dtypes)[name] in ("double", "float") else c


def reduction(df: DataFrame, kind: str, value: str | None, order: Sequence[str] = (), skipna: bool = True, ddof: int = 1) -> Column:
    """One of the twenty reductions as an aggregate expression."""
    if kind in ("size", "count") and value is None:
        return F.count("*")
    v = _value(value, df, skipna)
    at = F.struct(*order) if order else None
    n = F.count(v)
    simple = {
        "count": n, "sum": F.sum(v), "prod": F.product(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "median": F.median(v), "nunique": F.count_distinct(v),
        "any": F.max(v.cast("boolean")), "all": F.min(v.cast("boolean")), "or": F.bit_or(v), "and": F.bit_and(v), "xor": F.bit_xor(v),
        "unique": F.sort_array(F.collect_set(v)), "size": F.count("*"),
    }
    if kind in simple:
        return simple[kind]
    if kind in ("var", "std"):
        out = F.when(n > ddof, F.var_pop(v) * n / (n - ddof)).otherwise(F.lit(NAN))
        return F.sqrt(out) if kind == "std" else out
    if kind == "mode":
        return F.mode(v, True)
    if kind == "skew":
        return F.skewness(v)
    if at is None:
        raise ValueError(f"{kind} needs an order")
    if kind == "first":
        return F.min_by(v, F.when(v.isNotNull(), at))
    if kind == "last":
        return F.max_by(v, F.when(v.isNotNull(), at))
    if kind == "argmin":
        return F.min(F.when(v.isNotNull(), F.struct(v.alias("v"), at.alias("at"))))["at"]
    if kind == "argmax":
        return F.max_by(at, F.when(v.isNotNull(), F.struct(v.alias("v"), *[-F.col(x) for x in order])))
    raise ValueError(f"unknown reduction {kind!r}")


def aggregate(df: DataFrame, keys: Sequence[str], asked: dict[str, tuple], order: Sequence[str] = (), dropna: bool = True, **more) -> DataFrame:
    """asked: output name -> (reduction, column). Rows with a missing key are left out with ``dropna``."""
    kept = df
    if dropna:
        kinds = dict(df.dtypes)
        for k in keys:
            kept = kept.where(F.col(k).isNotNull() & (~F.isnan(k) if kinds[k] in ("double", "float") else F.lit(True)))
    plain = {out: x for out, x in asked.items() if not keys or x[0] not in BY_VALUE}
    done = kept.groupBy(*keys).agg(*[reduction(df, kind, value, order, **more).alias(out) for out, (kind, value) in plain.items()]) if plain else None
    for column in dict.fromkeys(value for out, (_, value) in asked.items() if out not in plain):
        part = _by_value(kept, keys, column, {out: kind for out, (kind, value) in asked.items() if out not in plain and value == column}, more.get("skipna", True))
        if done is None:
            done = part
            continue
        other = part.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
        done = done.join(other, same).drop(*[f"__k{i}" for i in range(len(keys))])
    return done.select(*[f"`{k}`" for k in keys], *[f"`{out}`" for out in asked])


def _by_value(df: DataFrame, keys: Sequence[str], column: str, kinds: dict[str, str], skipna: bool) -> DataFrame:
    counted = df.groupBy(*keys, _value(column, df, skipna).alias("__v")).agg(F.count("*").alias("__c"))
    least = F.min(F.when(F.col("__v").isNotNull(), F.struct((-F.col("__c")).alias("c"), F.col("__v").alias("v"))))["v"]
    made = {"median": F.percentile("__v", 0.5, F.col("__c")), "nunique": F.count("__v"), "unique": F.sort_array(F.collect_set("__v")), "mode": least}
    return counted.groupBy(*keys).agg(*[made[kind].alias(out) for out, kind in kinds.items()])


def whole(df: DataFrame, asked: dict[str, tuple], order: Sequence[str] = (), **more) -> DataFrame:
    """Whole-table reductions: one row."""
    return df.agg(*[reduction(df, kind, value, order, **more).alias(out) for out, (kind, value) in asked.items()])


def mode(df: DataFrame, keys: Sequence[str], value: str, out: str = "mode") -> DataFrame:
    """The most frequent value, the least one among ties; counted before it is compared, so one hot key is spread by value."""
    counted = df.groupBy(*keys, value).count()
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("c"), F.col(value).alias("v")))["v"].alias(out))


def head(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 5, last: bool = False) -> DataFrame:
    """The first (or last) n rows of every group. A limit on the rank lets each task keep n rows a group before the shuffle."""
    columns = [F.desc(x) if last else F.asc(x) for x in order]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*columns))).where(F.col("__rank") <= n).drop("__rank")


def sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """n rows of every group at random; with ``order`` (a unique key) the choice is repeatable."""
    noise = F.xxhash64(*order, F.lit(seed)) if order else F.rand(seed)
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(noise, *order))).where(F.col("__rank") <= n).drop("__rank")


def broadcast_back(df: DataFrame, keys: Sequence[str], asked: dict[str, tuple], order: Sequence[str] = ()) -> DataFrame:
    """Every row with its group's reductions: aggregate, then join, so hot groups stay combinable."""
    return df.join(aggregate(df, keys, asked, order, dropna=False), list(keys), "left")


def filter_by_range(df: DataFrame, keys: Sequence[str], low: int = 1, high: int | None = None) -> DataFrame:
    """Rows whose group has between low and high rows."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n")).where((F.col("__n") >= low) & (F.lit(True) if high is None else F.col("__n") <= high))
    return df.join(sizes, list(keys), "left_semi")


def codes(df: DataFrame, keys: Sequence[str], out: str = "code") -> DataFrame:
    """Every row with the dense number of its key, in key order."""
    from tessella.operators.position import with_position

    return df.join(with_position(df.select(*keys).distinct(), keys, out), list(keys))
