"""Ragged rows (arrays of any length) as Column builders on array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.math import col


def lengths(a) -> Column:
    return F.size(col(a))


def non_empty(a) -> Column:
    return F.size(col(a)) > 0


def get_jth(a, j: int, default=None) -> Column:
    """Element j, from the end if negative; the default where the row is too short."""
    return F.coalesce(F.try_element_at(col(a), F.lit(j + 1 if j >= 0 else j)), F.lit(default))


def set_jth(a, j: int, value) -> Column:
    at = j if j >= 0 else F.size(col(a)) + j
    return F.transform(col(a), lambda x, i: F.when(i == at, F.lit(value)).otherwise(x))


def get_prefixes(a, n: int, proper: bool = True) -> Column:
    return F.when(F.size(col(a)) >= n + proper, F.slice(col(a), 1, n))


def get_suffixes(a, n: int, proper: bool = True) -> Column:
    return F.when(F.size(col(a)) >= n + proper, F.slice(col(a), F.size(col(a)) - n + 1, F.lit(n)))


def get_length_n(a, n: int) -> Column:
    return F.when(F.size(col(a)) == n, col(a))


def get_ngrams(a, n: int) -> Column:
    """All windows of n neighbours, as arrays."""
    a = col(a)
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, F.lit(n)))).otherwise(F.slice(F.array(a), 1, 0))


def append(a, b) -> Column:
    return F.concat(col(a), col(b))


def append_single(a, x) -> Column:
    return F.array_append(col(a), x)


def prepend_single(a, x) -> Column:
    return F.array_prepend(col(a), x)


def remove_repeats(a) -> Column:
    """Runs of equal neighbours become one element."""
    a = col(a)
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def repeat_counts(a) -> Column:
    """The lengths of the runs that ``remove_repeats`` shortens."""
    a = col(a)
    starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | ~F.get(a, i).eqNullSafe(F.get(a, i - 1)))
    return F.when(F.size(a) > 0, F.transform(starts, lambda s, i: F.coalesce(F.get(starts, i + 1), F.size(a)) - s)).otherwise(F.array().cast("array<int>"))


def _fold(a, start, f) -> Column:
    return F.aggregate(col(a), start, f)


def sum_(a, kind: str = "double") -> Column:
    return _fold(a, F.lit(0).cast(kind), lambda x, y: x + y.cast(kind))


def prod(a) -> Column:
    return _fold(a, F.lit(1.0), lambda x, y: x * y)


def mean(a) -> Column:
    return F.when(F.size(col(a)) > 0, sum_(a) / F.size(col(a)))


def min_(a) -> Column:
    return F.array_min(col(a))


def max_(a) -> Column:
    return F.array_max(col(a))


def argmin(a) -> Column:
    """First position of the least element, from 0."""
    return F.array_position(col(a), F.array_min(col(a))) - 1


def argmax(a) -> Column:
    return F.array_position(col(a), F.array_max(col(a))) - 1


def any_(a) -> Column:
    return F.exists(col(a), lambda x: x.cast("boolean"))


def all_(a) -> Column:
    return F.forall(col(a), lambda x: x.cast("boolean"))


def or_(a) -> Column:
    return _fold(a, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y.cast("long")))


def and_(a) -> Column:
    return _fold(a, F.lit(-1).cast("long"), lambda x, y: x.bitwiseAND(y.cast("long")))


def xor(a) -> Column:
    return _fold(a, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y.cast("long")))


def nunique(a) -> Column:
    return F.size(F.array_distinct(col(a)))


def unique(a) -> Column:
    return F.sort_array(F.array_distinct(col(a)))


def intersect(a, b) -> Column:
    return F.sort_array(F.array_intersect(col(a), col(b)))


def union(a, b) -> Column:
    return F.sort_array(F.array_union(col(a), col(b)))


def setdiff(a, b) -> Column:
    return F.sort_array(F.array_except(col(a), col(b)))


def setxor(a, b) -> Column:
    return F.sort_array(F.array_union(F.array_except(col(a), col(b)), F.array_except(col(b), col(a))))


def filter_values(a, values: list, discard_empty: bool = False) -> Column:
    out = F.filter(col(a), lambda x: ~x.isin(values))
    return F.when(F.size(out) > 0, out) if discard_empty else out


def hash128(a) -> tuple[Column, Column]:
    return F.xxhash64(col(a)), F.xxhash64(F.lit("second"), col(a))


def vecdot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda x, y: x + y)


def flatten(df: DataFrame, row: str, a: str) -> DataFrame:
    """(row, pos, value): one row an element; empty rows vanish."""
    return df.select(row, F.posexplode(a).alias("pos", "value"))


def gather(df: DataFrame, row: str, pos: str, value: str, out: str = "values") -> DataFrame:
    """The inverse of ``flatten`` for rows that are not empty. A row must fit one executor."""
    return df.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda x: x[value]).alias(out))
