"""N-dimensional arrays in long form: one row an element, index columns ``i0, i1, ...`` and ``v``.

Element-wise operations between arrays are equi-joins on the index; scalars and
functions are projections; reductions are one aggregation with map-side
combine. Shapes are known on the driver, elements never are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.create import broadcast_shapes


class NDArray:
    def __init__(self, df: DataFrame, shape: Sequence[int]):
        self.df, self.shape = df, tuple(shape)

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(self.ndim)]

    @classmethod
    def from_function(cls, spark: SparkSession, shape: Sequence[int], f: Callable[..., Column]) -> NDArray:
        """Elements as a function of their indices, made in the executors."""
        base, rest, columns = spark.range(math.prod(shape)), F.col("id"), []
        for n in reversed(shape):
            columns.append(rest % n)
            rest = F.call_function("div", rest, F.lit(n))
        columns = list(reversed(columns))
        named = base.select(*[c.alias(f"i{k}") for k, c in enumerate(columns)])
        return cls(named.withColumn("v", f(*[F.col(f"i{k}") for k in range(len(shape))])), shape)

    @classmethod
    def zeros(cls, spark: SparkSession, shape: Sequence[int]) -> NDArray:
        return cls.from_function(spark, shape, lambda *_: F.lit(0.0))

    @classmethod
    def arange(cls, spark: SparkSession, n: int) -> NDArray:
        return cls.from_function(spark, [n], lambda i: i)

    def flat(self) -> Column:
        """The position in row-major order."""
        out = F.lit(0).cast("long")
        for a, n in zip(self.axes, self.shape, strict=True):
            out = out * n + F.col(a)
        return out

    def map(self, f: Callable[[Column], Column]) -> NDArray:
        return NDArray(self.df.withColumn("v", f(F.col("v"))), self.shape)

    def broadcast_to(self, shape: Sequence[int]) -> NDArray:
        """New leading axes, and axes of length 1, are repeated."""
        shape = tuple(shape)
        if broadcast_shapes(self.shape, shape) != shape:
            raise ValueError(f"{self.shape} does not fit {shape}")
        more = len(shape) - self.ndim
        df = self.df.select(*[F.col(a).alias(f"i{k + more}") for k, a in enumerate(self.axes)], "v")
        for k, n in enumerate(shape):
            if k < more or self.shape[k - more] != n:
                df = df.withColumn(f"i{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return NDArray(df.select(*[f"i{k}" for k in range(len(shape))], "v"), shape)

    def zip(self, other: NDArray, f: Callable[[Column, Column], Column]) -> NDArray:
        shape = broadcast_shapes(self.shape, other.shape)
        a = self if self.shape == shape else self.broadcast_to(shape)
        b = other if other.shape == shape else other.broadcast_to(shape)
        met = a.df.join(b.df.withColumnRenamed("v", "__w"), a.axes) if a.axes else a.df.crossJoin(b.df.withColumnRenamed("v", "__w"))
        return NDArray(met.withColumn("v", f(F.col("v"), F.col("__w"))).drop("__w"), shape)

    def _binary(self, other, f) -> NDArray:
        return self.zip(other, f) if isinstance(other, NDArray) else self.map(lambda v: f(v, F.lit(other)))

    def __add__(self, other):
        return self._binary(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._binary(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._binary(other, lambda a, b: a * b)

    def __truediv__(self, other):
        from tessella.functions.math import true_divide

        return self._binary(other, true_divide)

    def __neg__(self):
        return self.map(lambda v: -v)

    def __lt__(self, other):
        return self._binary(other, lambda a, b: a < b)

    def __gt__(self, other):
        return self._binary(other, lambda a, b: a > b)

    def __matmul__(self, other: NDArray) -> NDArray:
        """Two-dimensional product."""
        a = self.df.select("i0", F.col("i1").alias("__k"), F.col("v").alias("__a"))
        b = other.df.select(F.col("i0").alias("__k"), "i1", F.col("v").alias("__b"))
        return NDArray(a.join(b, "__k").groupBy("i0", "i1").agg(F.sum(F.col("__a") * F.col("__b")).alias("v")), (self.shape[0], other.shape[1]))

    def reduce(self, agg: Callable[[Column], Column], axis: int | Sequence[int] | None = None, keepdims: bool = False) -> NDArray:
        gone = set(range(self.ndim)) if axis is None else {a % self.ndim for a in ([axis] if isinstance(axis, int) else axis)}
        kept = [k for k in range(self.ndim) if k not in gone]
        out = self.df.groupBy(*[f"i{k}" for k in kept]).agg(agg(F.col("v")).alias("v"))
        if keepdims:
            return NDArray(out.select(*[F.lit(0).cast("long").alias(f"i{k}") if k in gone else F.col(f"i{k}") for k in range(self.ndim)], "v"), [1 if k in gone else n for k, n in enumerate(self.shape)])
        return NDArray(out.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(kept)], "v"), [self.shape[k] for k in kept])

    def sum(self, axis=None, keepdims=False):
        return self.reduce(F.sum, axis, keepdims)

    def prod(self, axis=None, keepdims=False):
        return self.reduce(F.product, axis, keepdims)

    def mean(self, axis=None, keepdims=False):
        return self.reduce(F.avg, axis, keepdims)

    def min(self, axis=None, keepdims=False):
        return self.reduce(F.min, axis, keepdims)

    def max(self, axis=None, keepdims=False):
        return self.reduce(F.max, axis, keepdims)

    def var(self, axis=None, keepdims=False):
        return self.reduce(F.var_pop, axis, keepdims)

    def std(self, axis=None, keepdims=False):
        return self.reduce(F.stddev_pop, axis, keepdims)

    def any(self, axis=None, keepdims=False):
        return self.reduce(lambda v: F.max(v.cast("boolean")), axis, keepdims)

    def all(self, axis=None, keepdims=False):
        return self.reduce(lambda v: F.min(v.cast("boolean")), axis, keepdims)

    def argmax(self, axis: int) -> NDArray:
        place = F.col(f"i{axis % self.ndim}")
        return self.reduce(lambda v: F.max_by(place, F.struct(v, -place)), axis)

    def argmin(self, axis: int) -> NDArray:
        place = F.col(f"i{axis % self.ndim}")
        return self.reduce(lambda v: F.min_by(place, F.struct(v, place)), axis)

    def reshape(self, *shape: int) -> NDArray:
        if math.prod(shape) != self.size:
            raise ValueError(f"{self.size} elements do not fit {shape}")
        rest, columns = self.flat(), []
        for n in reversed(shape):
            columns.append(rest % n)
            rest = F.call_function("div", rest, F.lit(n))
        return NDArray(self.df.select(*[c.alias(f"i{k}") for k, c in enumerate(reversed(columns))], "v"), shape)

    def permute_dims(self, order: Sequence[int]) -> NDArray:
        return NDArray(self.df.select(*[F.col(f"i{k}").alias(f"i{j}") for j, k in enumerate(order)], "v"), [self.shape[k] for k in order])

    def expand_dims(self, axis: int) -> NDArray:
        shape = list(self.shape)
        shape.insert(axis, 1)
        return self.reshape(*shape)

    def squeeze(self) -> NDArray:
        return self.reshape(*[n for n in self.shape if n != 1])

    def flip(self, axis: int) -> NDArray:
        return NDArray(self.df.withColumn(f"i{axis}", F.lit(self.shape[axis] - 1) - F.col(f"i{axis}")), self.shape)

    def roll(self, by: int, axis: int) -> NDArray:
        return NDArray(self.df.withColumn(f"i{axis}", F.pmod(F.col(f"i{axis}") + by, F.lit(self.shape[axis]))), self.shape)

    def take(self, start: int, stop: int, axis: int, stride: int = 1) -> NDArray:
        i = F.col(f"i{axis}")
        kept = self.df.where((i >= start) & (i < stop) & ((i - start) % stride == 0)).withColumn(f"i{axis}", F.call_function("div", i - start, F.lit(stride)))
        shape = list(self.shape)
        shape[axis] = max(0, -((start - min(stop, shape[axis])) // stride))
        return NDArray(kept, shape)

    def concat(self, other: NDArray, axis: int = 0) -> NDArray:
        shape = list(self.shape)
        shape[axis] += other.shape[axis]
        return NDArray(self.df.unionByName(other.df.withColumn(f"i{axis}", F.col(f"i{axis}") + self.shape[axis])), shape)

    def stack(self, other: NDArray, axis: int = 0) -> NDArray:
        return self.expand_dims(axis).concat(other.expand_dims(axis), axis)

    def where(self, a, b) -> NDArray:
        """This array is the condition."""
        first = self.zip(a, lambda c, x: F.struct(c.alias("c"), x.alias("x"))) if isinstance(a, NDArray) else self.map(lambda c: F.struct(c.alias("c"), F.lit(a).alias("x")))
        pick = lambda s, y: F.when(s["c"], s["x"]).otherwise(y)
        return first.zip(b, pick) if isinstance(b, NDArray) else first.map(lambda s: pick(s, F.lit(b)))

    def nonzero(self) -> DataFrame:
        return self.df.where(F.col("v") != 0).select(*self.axes)

    def unique_counts(self) -> DataFrame:
        return self.df.groupBy("v").count()

    def unique_all(self) -> tuple[DataFrame, NDArray]:
        """(v, code, first flat position, count) of every distinct value, and the array of codes."""
        from tessella.operators.position import with_position

        flat = self.df.withColumn("__flat", self.flat())
        kinds = with_position(flat.groupBy("v").agg(F.min("__flat").alias("first"), F.count("*").alias("n")), ["v"], "code")
        return kinds, NDArray(self.df.join(kinds.select("v", "code"), "v").select(*self.axes, F.col("code").alias("v")), self.shape)

    def unique_inverse(self) -> tuple[DataFrame, NDArray]:
        kinds, codes = self.unique_all()
        return kinds.select("v", "code"), codes

    def _cumulative(self, agg: Callable[[Column], Column], unit: float, join: Callable[[Column, Column], Column], axis: int, initial: bool, block: int = 1 << 16) -> NDArray:
        """Two levels: within blocks of an axis, and over the totals of its blocks."""
        i = f"i{axis % self.ndim}"
        rest = [a for a in self.axes if a != i]
        cut = self.df.withColumn("__b", F.floor(F.col(i) / block))
        totals = cut.groupBy(*rest, "__b").agg(agg(F.col("v")).alias("__t"))
        before = Window.partitionBy(*rest).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(*rest, "__b", F.coalesce(agg(F.col("__t")).over(before), F.lit(unit)).alias("__c"))
        inside = Window.partitionBy(*rest, "__b").orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
        done = cut.withColumn("__own", agg(F.col("v")).over(inside)).join(carry, [*rest, "__b"]).select(*self.axes, join(F.col("__own"), F.col("__c")).alias("v"))
        shape = list(self.shape)
        if initial:
            shape[axis % self.ndim] += 1
            first = self.df.select(*rest).distinct() if rest else self.df.sparkSession.range(1).select()
            done = done.withColumn(i, F.col(i) + 1).unionByName(first.withColumns({i: F.lit(0).cast("long"), "v": F.lit(unit)}), allowMissingColumns=False)
        return NDArray(done, shape)

    def cumulative_sum(self, axis: int = 0, include_initial: bool = False) -> NDArray:
        return self._cumulative(F.sum, 0.0, lambda own, c: own + c, axis, include_initial)

    def cumulative_prod(self, axis: int = 0, include_initial: bool = False) -> NDArray:
        return self._cumulative(F.product, 1.0, lambda own, c: own * c, axis, include_initial)

    def pad(self, widths: Sequence[tuple[int, int]], value=0.0) -> NDArray:
        """Another value around the array: (before, behind) of every axis."""
        shape = [n + a + b for n, (a, b) in zip(self.shape, widths, strict=True)]
        whole = NDArray.from_function(self.df.sparkSession, shape, lambda *_: F.lit(None).cast("boolean")).df.drop("v")
        moved = self.df.select(*[(F.col(x) + a).alias(x) for x, (a, _) in zip(self.axes, widths, strict=True)], "v", F.lit(True).alias("__own"))
        return NDArray(whole.join(moved, self.axes, "left").select(*self.axes, F.when(F.col("__own"), F.col("v")).otherwise(F.lit(value)).alias("v")), shape)

    def unstack(self, axis: int = 0) -> list[NDArray]:
        """The slices along an axis, each without it."""
        i, rest = f"i{axis % self.ndim}", [a for a in self.axes if a != f"i{axis % self.ndim}"]
        names = [F.col(a).alias(f"i{k}") for k, a in enumerate(rest)]
        shape = [n for k, n in enumerate(self.shape) if k != axis % self.ndim]
        return [NDArray(self.df.where(F.col(i) == k).select(*names, "v"), shape) for k in range(self.shape[axis % self.ndim])]

    def take_indices(self, indices: DataFrame, axis: int, count: int) -> NDArray:
        """The slices that a table (at, index) asks for, ``count`` of them; one may be asked for several times."""
        i = f"i{axis % self.ndim}"
        asked = indices.select(F.col("at").alias("__at"), F.col("index").alias(i))
        shape = list(self.shape)
        shape[axis % self.ndim] = count
        return NDArray(self.df.join(asked, i).select(*[F.col("__at").alias(i) if a == i else F.col(a) for a in self.axes], "v"), shape)

    def quantile(self, q: float, axis: int, method: str = "linear", keepdims: bool = False) -> NDArray:
        """An exact quantile along an axis."""
        from tessella.operators.stats import grouped_quantiles

        gone = axis % self.ndim
        rest = [a for a in self.axes if a != f"i{gone}"]
        done = grouped_quantiles(self.df, rest, "v", [q], method)
        if keepdims:
            return NDArray(done.select(*[F.lit(0).cast("long").alias(a) if a == f"i{gone}" else F.col(a) for a in self.axes], F.col("value").alias("v")), [1 if k == gone else n for k, n in enumerate(self.shape)])
        return NDArray(done.select(*[F.col(a).alias(f"i{k}") for k, a in enumerate(rest)], F.col("value").alias("v")), [n for k, n in enumerate(self.shape) if k != gone])

    def median(self, axis: int, keepdims: bool = False) -> NDArray:
        return self.quantile(0.5, axis, "linear", keepdims)

    def sort(self) -> NDArray:
        """A vector in order."""
        from tessella.operators.position import with_position

        return NDArray(with_position(self.df.select("v"), ["v"], "i0").select("i0", "v"), self.shape)

    def to_numpy(self, limit: int = 1_000_000):
        """Refuses more elements than ``limit``."""
        import numpy as np

        if self.size > limit:
            raise MemoryError(f"{self.size} elements; the limit is {limit}")
        out = np.zeros(self.shape)
        for *at, v in self.df.select(*self.axes, "v").collect():
            out[tuple(at)] = v
        return out


def meshgrid(*vectors: NDArray, indexing: str = "xy") -> list[NDArray]:
    """The coordinates of the grid that the vectors span; with 'xy' the first two axes change places."""
    axes = list(range(len(vectors)))
    if indexing == "xy" and len(axes) > 1:
        axes[0], axes[1] = 1, 0
    shape = [0] * len(vectors)
    for k, x in zip(axes, vectors, strict=True):
        shape[k] = x.shape[0]
    return [x.reshape(*[x.shape[0] if j == k else 1 for j in range(len(vectors))]).broadcast_to(shape) for k, x in zip(axes, vectors, strict=True)]
