"""Index objects: label columns with a position, lazy as everything else here.

An Index is a table of label columns and ``pos``, the place of every label from
0. What looks at single labels (``labels[3]``, ``to_dict``) brings them to the
driver and is bounded by a guard; all else stays a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import position

#: Labels that ``tolist`` and ``to_dict`` bring to the driver at most.
MOST = 1 << 20


class Index:
    """One or several label columns; ``pos`` orders them."""

    def __init__(self, df: DataFrame, names: Sequence[str] | str, pos: str = "pos"):
        self.names = [names] if isinstance(names, str) else list(names)
        self.pos, self.df = pos, df.select(pos, *self.names)

    @classmethod
    def of(cls, df: DataFrame, names: Sequence[str] | str, order: Sequence[str]) -> Index:
        """The labels of a table, numbered in the order given."""
        return cls(position.with_position(df, order, "pos"), names)

    def _new(self, df: DataFrame, names: Sequence[str] | None = None) -> Index:
        return type(self)(df, names or self.names, self.pos)

    @property
    def name(self) -> str:
        return self.names[0]

    @property
    def nlevels(self) -> int:
        return len(self.names)

    @property
    def ndim(self) -> int:
        return 1

    @property
    def shape(self) -> tuple[int, ...]:
        return (len(self),)

    @property
    def dtypes(self) -> dict[str, str]:
        kinds = dict(self.df.dtypes)
        return {x: kinds[x] for x in self.names}

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, key):
        """A slice, a condition (Column) or positions give an Index; one position gives its label."""
        at = F.col(self.pos)
        if isinstance(key, Column):
            return self._renumbered(self.df.where(key))
        if isinstance(key, slice):
            start, stop, step = key.indices(len(self))
            if step <= 0:
                raise ValueError("slices go forward")
            inside = (at >= start) & (at < stop) & (F.pmod(at - start, F.lit(step)) == 0)
            return self._new(self.df.where(inside).withColumn(self.pos, F.floor((at - start) / step).cast("long")))
        if isinstance(key, int):
            row = self.df.where(at == (key if key >= 0 else len(self) + key)).first()
            if row is None:
                raise IndexError(key)
            return row[self.name] if self.nlevels == 1 else tuple(row[x] for x in self.names)
        asked = self.df.sparkSession.createDataFrame([(i, int(k)) for i, k in enumerate(key)], "__at long, __k long")
        return self._new(asked.join(self.df, asked["__k"] == self.df[self.pos]).drop(self.pos, "__k").withColumnRenamed("__at", self.pos))

    def _renumbered(self, df: DataFrame) -> Index:
        return self._new(position.with_position(df.withColumnRenamed(self.pos, "__old"), ["__old"], self.pos))

    def _met(self, other: Index) -> DataFrame:
        theirs = other.df.select(F.col(other.pos).alias("__p"), *[F.col(x).alias(f"__o{i}") for i, x in enumerate(other.names)])
        return self.df.join(theirs, F.col(self.pos) == F.col("__p"), "full")

    def _same(self) -> Column:
        """Labels at one place agree; NaN agrees with nothing, as in the arithmetic of numbers."""
        kinds, out = self.dtypes, F.lit(True)
        for i, x in enumerate(self.names):
            alike = F.col(x) == F.col(f"__o{i}")
            out = out & (alike & ~F.isnan(x) if kinds[x] in ("double", "float") else alike)
        return F.coalesce(out, F.lit(False))

    def eq(self, other: Index) -> DataFrame:
        """(pos, eq): place by place."""
        return self._met(other).select(F.coalesce(F.col(self.pos), F.col("__p")).alias(self.pos), self._same().alias("eq"))

    def ne(self, other: Index) -> DataFrame:
        return self.eq(other).select(self.pos, (~F.col("eq")).alias("ne"))

    def equals(self, other: Index) -> bool:
        """Same length, and the same labels in the same order."""
        return self.nlevels == other.nlevels and self.eq(other).where("not eq").isEmpty()

    def equal_levels(self, other: Index) -> bool:
        return self.names == other.names and self.dtypes == other.dtypes and self.equals(other)

    def is_unique(self) -> bool:
        return self.df.groupBy(*self.names).count().where("count > 1").isEmpty()

    def get_level_values(self, level: int | str) -> Index:
        return Index(self.df, self.names[level] if isinstance(level, int) else level, self.pos)

    def set_dtype(self, kind: str) -> Index:
        return self._new(self.df.withColumns({x: F.col(f"`{x}`").cast(kind) for x in self.names}))

    def _sorting(self, ascending: bool, na_position: str = "last") -> list[Column]:
        last = na_position == "last"
        way = {(True, True): F.asc_nulls_last, (True, False): F.asc_nulls_first, (False, True): F.desc_nulls_last, (False, False): F.desc_nulls_first}[ascending, last]
        return [*[way(x) for x in self.names], F.asc("__old")]

    def argsort(self, ascending: bool = True, na_position: str = "last") -> DataFrame:
        """(rank, pos): the stable permutation that sorts the labels."""
        ranked = position.with_position(self.df.withColumnRenamed(self.pos, "__old"), self._sorting(ascending, na_position), "rank")
        return ranked.select("rank", F.col("__old").alias(self.pos))

    def sort_values(self, ascending: bool = True, na_position: str = "last", return_indexer: bool = False):
        """The sorted Index; with ``return_indexer`` also (rank, pos)."""
        ranked = position.with_position(self.df.withColumnRenamed(self.pos, "__old"), self._sorting(ascending, na_position), self.pos)
        done = self._new(ranked.drop("__old"))
        return (done, ranked.select(F.col(self.pos).alias("rank"), F.col("__old").alias(self.pos))) if return_indexer else done

    def map(self, table: DataFrame, key: str = "key", value: str = "value") -> Index:
        """Labels by way of a table (key, value); labels without a key become null, of repeated keys the least value counts."""
        once = table.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__value"))
        met = self.df.join(once, F.col(self.name) == F.col("__key"), "left")
        return self._new(met.select(self.pos, F.col("__value").alias(self.name)), [self.name])

    def concat(self, other: Index) -> Index:
        """The labels of both, the other's behind."""
        n = len(self)
        behind = other.df.select((F.col(other.pos) + n).alias(self.pos), *[F.col(y).alias(x) for x, y in zip(self.names, other.names, strict=True)])
        return self._new(self.df.unionByName(behind))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(pos, labels, isin): which labels are among the keys."""
        marked = keys.select(*self.names).distinct().withColumn("isin", F.lit(True))
        return self.df.join(marked, self.names, "left").select(self.pos, *self.names, F.coalesce("isin", F.lit(False)).alias("isin"))

    def tolist(self) -> list:
        rows = self.df.orderBy(self.pos).limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise MemoryError(f"more than {MOST} labels")
        return [r[self.name] if self.nlevels == 1 else tuple(r[x] for x in self.names) for r in rows]

    def to_dict(self) -> dict[str, list]:
        rows = self.tolist()
        return {x: [r if self.nlevels == 1 else r[i] for r in rows] for i, x in enumerate(self.names)}

    def to_frame(self) -> DataFrame:
        return self.df


class MultiIndex(Index):
    """An Index of several levels, given as a table or built from level tables that share ``pos``."""

    @property
    def ndim(self) -> int:
        return self.nlevels

    @classmethod
    def from_levels(cls, *levels: Index) -> MultiIndex:
        first = levels[0]
        df, names = first.df, list(first.names)
        for level in levels[1:]:
            df = df.join(level.df.withColumnRenamed(level.pos, first.pos), first.pos)
            names += level.names
        return cls(df, names, first.pos)


def index(df: DataFrame, names: Sequence[str] | str, order: Sequence[str]) -> Index:
    """An Index or a MultiIndex, by the number of label columns."""
    several = not isinstance(names, str) and len(names) > 1
    return (MultiIndex if several else Index).of(df, names, order)
