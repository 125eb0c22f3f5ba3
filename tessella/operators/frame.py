"""Frame, Series, Index and group objects: thin lazy wrappers with the vocabulary of labelled arrays.

A Frame has an index column that orders its rows. Methods return new Frames;
nothing runs before data are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import groupby as g
from tessella.operators import joins, position, sets, stats
from tessella.operators.labels import Index, MultiIndex  # noqa: F401  (part of this vocabulary)


class Frame:
    def __init__(self, df: DataFrame, index: str = "index"):
        if index not in df.columns:
            raise KeyError(f"no index column {index!r}")
        self.df, self.index = df, index

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[str], index: str = "index") -> Frame:
        return cls(position.with_position(df, order, index), index)

    def _new(self, df: DataFrame) -> Frame:
        return Frame(df, self.index)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.index]

    @property
    def dtypes(self) -> dict[str, str]:
        return {k: v for k, v in self.df.dtypes if k != self.index}

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.columns)

    @property
    def size(self) -> int:
        n, m = self.shape
        return n * m

    @property
    def empty(self) -> bool:
        return self.df.isEmpty()

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, key):
        if isinstance(key, str):
            return Series(self.df.select(self.index, F.col(key).alias("value")), self.index, key)
        if isinstance(key, Column):
            return self._new(self.df.where(key))
        if isinstance(key, slice):
            i = F.col(self.index)
            if key.step not in (None, 1):
                return self._new(self.df.where((i >= (key.start or 0)) & (i < (key.stop if key.stop is not None else 1 << 62)) & ((i - (key.start or 0)) % key.step == 0)))
            return self._new(self.df.where((i >= (key.start or 0)) & (i < (key.stop if key.stop is not None else 1 << 62))))
        if isinstance(key, int):
            return self.df.where(F.col(self.index) == key).first()
        return self._new(self.df.select(self.index, *key))

    def assign(self, **columns: Column) -> Frame:
        return self._new(self.df.withColumns(columns))

    def drop(self, *columns: str) -> Frame:
        return self._new(self.df.drop(*columns))

    def rename(self, names: dict[str, str]) -> Frame:
        return self._new(self.df.withColumnsRenamed(names))

    def copy(self) -> Frame:
        return self._new(self.df)

    def head(self, n: int = 5) -> Frame:
        return self._new(self.df.orderBy(self.index).limit(n))

    def tail(self, n: int = 5) -> Frame:
        return self._new(position.tail(self.df, [self.index], n))

    def sample(self, n: int, seed: int = 0) -> Frame:
        return self._new(self.df.orderBy(F.xxhash64(self.index, F.lit(seed)), self.index).limit(n))

    def reset_index(self) -> Frame:
        return Frame.of(self.df.withColumnRenamed(self.index, "__old"), ["__old"], self.index).drop("__old")

    def append(self, other: Frame) -> Frame:
        """The other's rows behind; their index goes on."""
        n = self.df.agg(F.coalesce(F.max(self.index) + 1, F.lit(0))).first()[0]
        return self._new(self.df.unionByName(other.df.withColumn(self.index, F.col(other.index) + n)))

    def concat(self, *others: Frame) -> Frame:
        out = self
        for o in others:
            out = out.append(o)
        return out

    def argsort(self, by: Sequence[str]) -> DataFrame:
        return position.argsort(self.df, by, self.index)

    def sort_values(self, by: Sequence[str], ascending: bool = True) -> DataFrame:
        order = [F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c) for c in by]
        return self.df.orderBy(*order, self.index)

    def sort_index(self, ascending: bool = True) -> DataFrame:
        return self.df.orderBy(F.col(self.index).asc() if ascending else F.col(self.index).desc())

    def apply_permutation(self, permutation: DataFrame, rank: str = "rank", pos: str = "pos") -> Frame:
        moved = self.df.join(permutation.withColumnRenamed(pos, self.index), self.index).drop(self.index)
        return self._new(moved.withColumnRenamed(rank, self.index))

    def drop_duplicates(self, subset: Sequence[str] | None = None, keep: str = "first") -> Frame:
        return self._new(sets.drop_duplicates(self.df, list(subset or self.columns), [self.index], keep))

    def isna(self) -> Frame:
        return self._new(self.df.select(self.index, *[_missing(c, self.dtypes[c]).alias(c) for c in self.columns]))

    def notna(self) -> Frame:
        return self._new(self.df.select(self.index, *[(~_missing(c, self.dtypes[c])).alias(c) for c in self.columns]))

    def dropna(self, how: str = "any", subset: Sequence[str] | None = None, thresh: int | None = None) -> Frame:
        names = list(subset or self.columns)
        present = sum(((~_missing(c, self.dtypes[c])).cast("int") for c in names), F.lit(0))
        need = thresh if thresh is not None else len(names) if how == "any" else 1
        return self._new(self.df.where(present >= need))

    def fillna(self, value, subset: Sequence[str] | None = None) -> Frame:
        return self._new(self.df.withColumns({c: F.when(_missing(c, self.dtypes[c]), value).otherwise(F.col(c)) for c in (subset or self.columns)}))

    def count(self) -> DataFrame:
        return self.df.agg(*[F.count_if(~_missing(c, self.dtypes[c])).alias(c) for c in self.columns])

    def any(self) -> DataFrame:
        return self.df.agg(*[F.max(F.col(c).cast("boolean")).alias(c) for c in self.columns if self.dtypes[c] == "boolean"])

    def all(self) -> DataFrame:
        return self.df.agg(*[F.min(F.col(c).cast("boolean")).alias(c) for c in self.columns if self.dtypes[c] == "boolean"])

    def corr(self) -> DataFrame:
        numeric = [c for c in self.columns if self.dtypes[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")]
        return stats.cov_corr(self.df, numeric)

    def isin(self, values: Sequence) -> Frame:
        return self._new(self.df.select(self.index, *[F.col(c).isin(list(values)).alias(c) for c in self.columns]))

    def merge(self, other: Frame, **how) -> DataFrame:
        return joins.merge(self.df.drop(self.index), other.df.drop(other.index), **how)

    def groupby(self, *keys: str, dropna: bool = True) -> Groups:
        return Groups(self.df, keys, [self.index], dropna)

    def filter_by_range(self, keys: Sequence[str], low: int = 1, high: int | None = None) -> Frame:
        return self._new(g.filter_by_range(self.df, keys, low, high))

    def memory_usage(self) -> DataFrame:
        """Bytes by column: fixed widths, and the byte lengths of texts."""
        width = {"bigint": 8, "double": 8, "timestamp": 8, "int": 4, "float": 4, "smallint": 2, "tinyint": 1, "boolean": 1, "date": 4}
        return self.df.agg(*[(F.count("*") * width[t] if t in width else F.sum(F.octet_length(F.col(c).cast("string")) + 8)).alias(c) for c, t in self.dtypes.items()])

    def info(self) -> str:
        return "\n".join(f"{c}: {t}" for c, t in self.dtypes.items())

    def apply(self, f: Callable, kind: str, column: str) -> Frame:
        """An element-wise Python function on Arrow batches: the slow path, for what expressions can't say."""
        return self._new(self.df.withColumn(column, F.pandas_udf(lambda s: s.map(f), kind)(F.col(column))))

    def map(self, column: str, table: dict) -> Frame:
        """Values through a small dictionary; others become NULL."""
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        return self._new(self.df.withColumn(column, F.try_element_at(F.create_map(*pairs), F.col(column))))


def _missing(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


class Groups:
    """Reductions by key; every method is one aggregation."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], dropna: bool = True):
        self.df, self.keys, self.order, self.dropna = df, list(keys), list(order), dropna

    def agg(self, **asked: tuple) -> DataFrame:
        return g.aggregate(self.df, self.keys, asked, self.order, self.dropna)

    def __getattr__(self, kind: str):
        name = {"OR": "or", "AND": "and", "XOR": "xor", "or_": "or", "and_": "and"}.get(kind, kind)
        if name not in KINDS:
            raise AttributeError(kind)

        def call(*columns: str) -> DataFrame:
            values = columns or [c for c in self.df.columns if c not in (*self.keys, *self.order)]
            return self.agg(**{c: (name, c) for c in values})

        return call

    def size(self) -> DataFrame:
        return self.agg(size=("size", None))

    def head(self, n: int = 5) -> DataFrame:
        return g.head(self.df, self.keys, self.order, n)

    def tail(self, n: int = 5) -> DataFrame:
        return g.head(self.df, self.keys, self.order, n, last=True)

    def sample(self, n: int, seed: int = 0) -> DataFrame:
        return g.sample(self.df, self.keys, n, seed, self.order)

    def diff(self, column: str) -> DataFrame:
        return position.diff(self.df, self.order, column, partition_by=self.keys)

    def diffs(self, column: str) -> Differences:
        """Reductions over the differences of consecutive rows."""
        return Differences(self, column)

    def broadcast(self, **asked: tuple) -> DataFrame:
        return g.broadcast_back(self.df, self.keys, asked, self.order)


class Differences:
    """Grouped reductions of differences; the first row of a group has none."""

    def __init__(self, groups: Groups, column: str):
        self.keys, self.order, self.column = list(groups.keys), list(groups.order), column
        self.df = position.diff(groups.df, self.order, column, "__diff", self.keys)

    def agg(self, **asked: str) -> DataFrame:
        """Output name = reduction."""
        return g.aggregate(self.df, self.keys, {out: (kind, "__diff") for out, kind in asked.items()}, self.order)

    def __getattr__(self, kind: str):
        if kind.rstrip("_") not in KINDS:
            raise AttributeError(kind)
        return lambda: self.agg(**{self.column: kind.rstrip("_")})


KINDS = ("sum", "count", "prod", "var", "std", "mean", "median", "min", "max", "argmin", "argmax", "nunique", "any", "all", "or", "and", "xor", "first", "last", "mode", "unique", "skew")


class Accessor:
    """The functions of a module, applied to a Series' values: ``s.str.upper()``, ``s.dt.floor("h")``."""

    def __init__(self, series: Series, module):
        self.series, self.module = series, module

    def __getattr__(self, name: str):
        f = getattr(self.module, name)
        return lambda *args, **more: self.series._new(f("value", *args, **more))


class Series:
    """(index, value)."""

    def __init__(self, df: DataFrame, index: str = "index", name: str = "value"):
        self.df, self.index, self.name = df, index, name

    @property
    def str(self) -> Accessor:
        from tessella.functions import strings

        return Accessor(self, strings)

    @property
    def dt(self) -> Accessor:
        from tessella.functions import times

        return Accessor(self, times)

    def part(self, name) -> Series:
        """A calendar field of timestamps."""
        from tessella.functions import times

        return self._new(times.parts("value")[name])

    def map(self, table: dict) -> Series:
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        return self._new(F.try_element_at(F.create_map(*pairs), F.col("value")))

    def head(self, n: int = 5) -> Series:
        return Series(self.df.orderBy(self.index).limit(n), self.index, self.name)

    def tail(self, n: int = 5) -> Series:
        return Series(position.tail(self.df, [self.index], n), self.index, self.name)

    def iloc(self, start: int, stop: int) -> Series:
        """By place in index order, whatever the labels."""
        numbered = position.with_position(self.df, [self.index], "__pos")
        return Series(numbered.where((F.col("__pos") >= start) & (F.col("__pos") < stop)).drop("__pos"), self.index, self.name)

    def _value(self, kind: str):
        row = g.whole(self.df, {"x": (kind, "value")}, [self.index]).first()
        return row["x"][self.index] if kind.startswith("arg") and row["x"] is not None else row["x"]

    def sum(self):
        return self._value("sum")

    def prod(self):
        return self._value("prod")

    def mean(self):
        return self._value("mean")

    def min(self):
        return self._value("min")

    def max(self):
        return self._value("max")

    def std(self):
        return self._value("std")

    def var(self):
        return self._value("var")

    def argmin(self):
        return self._value("argmin")

    def argmax(self):
        return self._value("argmax")

    def nunique(self):
        return self._value("nunique")

    def _new(self, value: Column) -> Series:
        return Series(self.df.withColumn("value", value), self.index, self.name)

    def isna(self) -> Series:
        return self._new(_missing("value", dict(self.df.dtypes)["value"]))

    def notna(self) -> Series:
        return self._new(~_missing("value", dict(self.df.dtypes)["value"]))

    def fillna(self, by) -> Series:
        return self._new(F.when(_missing("value", dict(self.df.dtypes)["value"]), by).otherwise(F.col("value")))

    def isin(self, values: Sequence) -> Series:
        return self._new(F.col("value").isin(list(values)))

    def add(self, other: Series) -> Series:
        """By label; labels in one only give NULL."""
        met = self.df.join(other.df.select(F.col(other.index).alias(self.index), F.col("value").alias("__o")), self.index, "full")
        return Series(met.select(self.index, (F.col("value") + F.col("__o")).alias("value")), self.index, self.name)

    def topn(self, n: int = 10) -> DataFrame:
        return position.top_k(self.df, "value", n, ties=[self.index])

    def value_counts(self) -> DataFrame:
        return sets.value_counts(self.df, "value")

    def diff(self) -> DataFrame:
        return position.diff(self.df, [self.index], "value")

    def cumsum(self) -> DataFrame:
        return position.running(self.df, [self.index], F.col("value"), "cumsum")

    def sort_values(self, ascending: bool = True) -> DataFrame:
        return self.df.orderBy(F.asc_nulls_last("value") if ascending else F.desc_nulls_last("value"), self.index)

    def sort_index(self) -> DataFrame:
        return self.df.orderBy(self.index)

    @property
    def shape(self) -> tuple[int]:
        return (self.df.count(),)

    @property
    def size(self) -> int:
        return self.df.count()

    @property
    def ndim(self) -> int:
        return 1

    @property
    def dtype(self) -> str:
        return dict(self.df.dtypes)["value"]

    def __len__(self) -> int:
        return self.df.count()

    def hasnans(self) -> bool:
        return not self.df.where(_missing("value", self.dtype)).isEmpty()

    def loc(self, labels: DataFrame | Sequence | Column) -> Series:
        """The rows of some labels (a table's column of the index's name, a list, or a condition), each as often as it stands here."""
        if isinstance(labels, DataFrame):
            return Series(self.df.join(labels.select(self.index), self.index, "left_semi"), self.index, self.name)
        return Series(self.df.where(labels if isinstance(labels, Column) else F.col(self.index).isin(list(labels))), self.index, self.name)

    def set_loc(self, labels: DataFrame | Sequence | Column, value) -> Series:
        """The series with another value at some labels."""
        put = lambda here: F.when(here, F.lit(value)).otherwise(F.col("value")).alias("value")
        if isinstance(labels, DataFrame):
            marked = labels.select(self.index, F.lit(True).alias("__here")).distinct()
            return Series(self.df.join(marked, self.index, "left").select(self.index, put(F.col("__here"))), self.index, self.name)
        return Series(self.df.select(self.index, put(labels if isinstance(labels, Column) else F.col(self.index).isin(list(labels)))), self.index, self.name)

    def at(self, label):
        """The value of one label; a list where it stands on several rows."""
        found = [r["value"] for r in self.df.where(F.col(self.index) == F.lit(label)).orderBy("value").limit(1001).collect()]
        if not found or len(found) > 1000:
            raise KeyError(label)
        return found[0] if len(found) == 1 else found

    def iat(self, place: int):
        """The value at one place in index order."""
        n = len(self)
        place = place if place >= 0 else n + place
        row = self.iloc(place, place + 1).df.first()
        if row is None:
            raise IndexError(place)
        return row["value"]

    def set_iloc(self, start: int, stop: int, value) -> Series:
        """The series with another value at some places in index order."""
        numbered = position.with_position(self.df, [self.index], "__pos")
        here = (F.col("__pos") >= start) & (F.col("__pos") < stop)
        return Series(numbered.select(self.index, F.when(here, F.lit(value)).otherwise(F.col("value")).alias("value")), self.index, self.name)

    def locate(self, labels: Sequence) -> Series:
        return Series(self.df.where(F.col(self.index).isin(list(labels))), self.index, self.name)

    def has_repeat_labels(self) -> bool:
        return not self.df.groupBy(self.index).count().where("count > 1").isEmpty()

    def to_frame(self) -> Frame:
        return Frame(self.df.withColumnRenamed("value", self.name), self.index)

    def concat(self, *others: Series) -> Series:
        return Series(sets.concatenate(self.df, *[o.df for o in others]), self.index, self.name)
