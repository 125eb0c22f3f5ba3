"""Merges, lookups, time-window joins and interval joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(left: DataFrame, right: DataFrame, on: Sequence[str] | str | None = None, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), left_on=None, right_on=None, convert_ints: bool = True, sort: bool = False) -> DataFrame:
    """Keys with one name appear once; other shared names get suffixes; holes turn integers to doubles."""
    if left_on is None:
        on = [on] if isinstance(on, str) else on
        left_on = right_on = list(on) if on is not None else [c for c in left.columns if c in right.columns]
    left_on, right_on = ([x] if isinstance(x, str) else list(x) for x in (left_on, right_on))
    shared = [a for a, b in zip(left_on, right_on, strict=True) if a == b]
    clash = (set(left.columns) & set(right.columns)) - set(shared)
    lname = lambda c: c + suffixes[0] if c in clash else c
    rname = lambda c: c + suffixes[1] if c in clash else c
    kinds = ("tinyint", "smallint", "int", "bigint")

    def side(df: DataFrame, name: Callable[[str], str], holes: bool, tag: str) -> DataFrame:
        types = dict(df.dtypes)
        wide = lambda c: F.col(f"`{c}`").cast("double") if convert_ints and holes and types[c] in kinds and c not in shared else F.col(f"`{c}`")
        return df.select(*[wide(c).alias(tag + name(c)) for c in df.columns])

    a = side(left, lname, how in ("right", "outer"), "__l_")
    b = side(right, rname, how in ("left", "outer"), "__r_")
    met = [F.col("__l_" + lname(x)) == F.col("__r_" + rname(y)) for x, y in zip(left_on, right_on, strict=True)]
    joined = a.join(b, met, how)
    out = [F.coalesce("__l_" + c, "__r_" + c).alias(c) if c in shared else F.col("__l_" + lname(c)).alias(lname(c)) for c in left.columns]
    out += [F.col("__r_" + rname(c)).alias(rname(c)) for c in right.columns if c not in shared]
    done = joined.select(*out)
    return done.orderBy(*left_on) if sort else done


def inner_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, where: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """Equi-join with an optional predicate on the pair."""
    on = left[left_on] == right[right_on]
    return left.join(right, on & where(left, right) if where else on)


def semi(left: DataFrame, right: DataFrame, on: Sequence[str], invert: bool = False) -> DataFrame:
    """Rows whose key is (not) in the other table."""
    return left.join(right.select(*on).distinct(), list(on), "left_anti" if invert else "left_semi")


def isin(left: DataFrame, right: DataFrame, on: Sequence[str], out: str = "isin") -> DataFrame:
    """All rows, marked."""
    marked = right.select(*on).distinct().withColumn(out, F.lit(True))
    return left.join(marked, list(on), "left").withColumn(out, F.coalesce(out, F.lit(False)))


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, fill=-1) -> DataFrame:
    """The value of each key; ``fill`` where there is none. Of repeated keys the least value counts."""
    once = table.groupBy(*keys).agg(F.min(value).alias(value))
    return df.join(once, list(keys), "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def find(df: DataFrame, terms: DataFrame, keys: Sequence[str], pos: str = "pos", every: bool = False) -> DataFrame:
    """First (or every) position at which each term occurs."""
    found = terms.select(*keys).distinct().join(df, list(keys))
    return found.groupBy(*keys).agg((F.sort_array(F.collect_list(pos)) if every else F.min(pos)).alias(pos))


def join_on_eq_with_dt(left: DataFrame, right: DataFrame, key: str, t_left: str, t_right: str, dt, predicate: str = "abs_dt", limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Pairs with equal keys and times within dt.

    Time is cut into spans of dt, so a pair lies in neighbouring spans: the
    join is on (key, span), and a hot key is spread over its spans. With a
    ``limit`` any so many pairs come out, or the first ones by ``order``.
    """
    a, b = left.alias("a"), right.alias("b")
    if predicate == "true_dt":
        out = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    else:
        span = lambda c: F.floor(c / F.lit(max(dt, 1)))
        near = [0, 1] if predicate == "pos_dt" else [-1, 0, 1]
        a = left.withColumn("__span", F.explode(F.array(*[span(F.col(t_left)) + i for i in near]))).alias("a")
        b = right.withColumn("__span", span(F.col(t_right))).alias("b")
        gap = F.col(f"b.{t_right}") - F.col(f"a.{t_left}")
        inside = F.abs(gap) <= dt if predicate == "abs_dt" else (gap >= 0) & (gap <= dt)
        out = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__span") == F.col("b.__span")) & inside)
    picked = out.select(*[F.col(f"a.{c}").alias(f"left_{c}") for c in left.columns], *[F.col(f"b.{c}").alias(f"right_{c}") for c in right.columns])
    if limit is None:
        return picked
    return (picked.orderBy(*order) if order else picked).limit(limit)


def search_intervals(df: DataFrame, intervals: DataFrame, value: str, low: str = "low", high: str = "high", width: float | None = None, tiebreak: str | None = None) -> DataFrame:
    """Every row with the interval (closed at both ends) that contains its value.

    The axis is cut into cells of ``width`` (by default the mean interval
    length); intervals are filed in each cell that they touch, so the join is
    an equi-join. Of several intervals the one of least ``tiebreak`` counts,
    else the one of least (low, high).
    """
    if width is None:
        width = intervals.agg(F.avg(F.col(high) - F.col(low))).first()[0] or 1.0
    width = float(width) or 1.0
    cell = lambda c: F.floor(c / F.lit(width)).cast("long")
    filed = intervals.select(*[F.col(c).alias("i_" + c) for c in intervals.columns]).withColumn("__cell", F.explode(F.sequence(cell(F.col("i_" + low)), cell(F.col("i_" + high)))))
    rank = F.struct(*([F.col("i_" + tiebreak)] if tiebreak else []), F.col("i_" + low), F.col("i_" + high))
    values = df.select(value).distinct().withColumn("__cell", cell(F.col(value)))
    hits = values.join(filed, "__cell").where((F.col("i_" + low) <= F.col(value)) & (F.col(value) <= F.col("i_" + high)))
    best = hits.groupBy(value).agg(F.min_by(F.struct(*["i_" + c for c in intervals.columns]), rank).alias("interval"))
    return df.join(best, value, "left")


def interval_lookup(df: DataFrame, intervals: DataFrame, value: str, payload: str, fill=-1, **more) -> DataFrame:
    out = search_intervals(df, intervals, value, **more)
    return out.withColumn(payload, F.coalesce(F.col(f"interval.i_{payload}"), F.lit(fill))).drop("interval")


def search_boxes(df: DataFrame, boxes: DataFrame, values: Sequence[str], lows: Sequence[str], highs: Sequence[str], width: float, key: str) -> DataFrame:
    """Per-dimension containment: filed by the first dimension, decided on all; the box of least key counts."""
    cell = lambda c: F.floor(c / F.lit(float(width))).cast("long")
    filed = boxes.withColumn("__cell", F.explode(F.sequence(cell(F.col(lows[0])), cell(F.col(highs[0])))))
    asked = df.select(*values).distinct().withColumn("__cell", cell(F.col(values[0])))
    inside = F.lit(True)
    for v, lo, hi in zip(values, lows, highs, strict=True):
        inside = inside & (F.col(lo) <= F.col(v)) & (F.col(v) <= F.col(hi))
    best = asked.join(filed, "__cell").where(inside).groupBy(*values).agg(F.min(key).alias(key))
    return df.join(best, list(values), "left")


def as_of(left: DataFrame, right: DataFrame, key: str, t_left: str, t_right: str, value: str) -> DataFrame:
    """Each left row with the right value of the latest time at or before its own (an extension)."""
    both = left.select("*", F.col(t_left).alias("__t"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side")).unionByName(
        right.select(F.col(key), F.col(t_right).alias("__t"), F.col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(order)).where("__side = 1").drop("__t", "__v", "__side")


def align(*tables: tuple[DataFrame, str]) -> list[DataFrame]:
    """Number the values of several columns alike, from 0 in order of value."""
    from tessella.operators.position import with_position

    values = tables[0][0].select(F.col(tables[0][1]).alias("__v"))
    for df, c in tables[1:]:
        values = values.unionByName(df.select(F.col(c).alias("__v")))
    numbered = with_position(values.distinct(), ["__v"], "code")
    return [df.join(numbered.withColumnRenamed("__v", c), c) for df, c in tables]
