"""Seeded random columns and tables. Values depend on the seed and the row's number, not on the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unit(key: Column, seed: int, stream: int = 0) -> Column:
    """Uniform in (0, 1), a function of key, seed and stream."""
    h = F.xxhash64(key.cast("long"), F.lit(seed), F.lit(stream))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


class Generator:
    """Columns over a unique integer key; each call draws from the next stream."""

    def __init__(self, seed: int = 0, key: str = "pos"):
        self.seed, self.key, self.stream = seed, key, 0

    def _u(self) -> Column:
        self.stream += 1
        return unit(F.col(self.key), self.seed, self.stream)

    def random(self) -> Column:
        return self._u()

    def uniform(self, low: float = 0.0, high: float = 1.0) -> Column:
        return low + (high - low) * self._u()

    def integers(self, low: int, high: int) -> Column:
        return (F.floor(self._u() * (high - low)) + low).cast("long")

    def standard_normal(self) -> Column:
        return F.sqrt(-2 * F.ln(self._u())) * F.cos(2 * math.pi * self._u())

    def normal(self, loc: float = 0.0, scale: float = 1.0) -> Column:
        return loc + scale * self.standard_normal()

    def lognormal(self, mean: float = 0.0, sigma: float = 1.0) -> Column:
        return F.exp(self.normal(mean, sigma))

    def standard_exponential(self) -> Column:
        return -F.ln(self._u())

    def exponential(self, scale: float = 1.0) -> Column:
        return scale * self.standard_exponential()

    def logistic(self, loc: float = 0.0, scale: float = 1.0) -> Column:
        u = self._u()
        return loc + scale * F.ln(u / (1 - u))

    def _accepted(self, propose) -> Column:
        """The first accepted of a row of proposals; ``propose`` gets uniforms and returns (accepted, value). All 200 fail in less than 1 in 10**100 rows."""
        first = self.stream + 1
        self.stream += 4
        key = F.col(self.key).cast("long")

        def step(found: Column, i: Column) -> Column:
            u = [(F.shiftrightunsigned(F.xxhash64(key, F.lit(self.seed), F.lit(first + s), i), 11).cast("double") + 0.5) / float(1 << 53) for s in range(4)]
            fine, value = propose(*u)
            return F.when(found.isNotNull(), found).when(fine, value)

        return F.aggregate(F.sequence(F.lit(1), F.lit(200)), F.lit(None).cast("double"), step)

    def standard_gamma(self, shape: float) -> Column:
        """Marsaglia and Tsang."""
        boost = shape < 1
        d = (shape + 1 if boost else shape) - 1 / 3
        c = 1 / math.sqrt(9 * d)

        def propose(u, v, w, _):
            x = F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)
            cube = F.pow(1 + c * x, F.lit(3.0))
            return (1 + c * x > 0) & (F.ln(w) < 0.5 * x * x + d - d * cube + d * F.ln(F.when(cube > 0, cube))), d * cube

        out = self._accepted(propose)
        return out * F.pow(self._u(), F.lit(1 / shape)) if boost else out

    def poisson(self, lam: float) -> Column:
        """By inversion: how many of the cumulative probabilities lie below a uniform; from 100 on by rejection from a transformed uniform (Hörmann)."""
        if lam >= 100:
            b = 0.931 + 2.53 * math.sqrt(lam)
            a, top, cut = -0.059 + 0.02483 * b, 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2)

            def propose(u, v, *_):
                u = u - 0.5
                near = 0.5 - F.abs(u)
                k = F.floor((2 * a / near + b) * u + lam + 0.43).cast("double")
                x = F.when(k >= 0, k + 1)  # ln gamma(x) by Stirling's series
                gamma = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
                slow = F.ln(v * top / (a / (near * near) + b)) <= k * math.log(lam) - lam - gamma
                return ((near >= 0.07) & (v <= cut)) | ((k >= 0) & ~((near < 0.013) & (v > near)) & slow), k

            return self._accepted(propose).cast("long")
        top = int(lam + 12 * math.sqrt(lam) + 20)
        p, total, cumulative = math.exp(-lam), 0.0, []
        for k in range(top):
            total += p
            cumulative.append(total)
            p *= lam / (k + 1)
        u = self._u()
        steps = F.array(*[F.lit(x) for x in cumulative])
        return F.size(F.filter(steps, lambda c: c <= u)).cast("long")

    def choice(self, df: DataFrame, n: int, replace: bool = False) -> DataFrame:
        """n rows of a table numbered by the key from 0."""
        if not replace:
            return df.orderBy(self._u(), self.key).limit(n)
        total = df.count()
        asked = df.sparkSession.range(n).select(F.floor(unit(F.col("id"), self.seed, 1000 + self.stream) * total).cast("long").alias(self.key), F.col("id").alias("draw"))
        return asked.join(df, self.key)

    def permutation(self, df: DataFrame, out: str = "perm") -> DataFrame:
        """The rows numbered in random order."""
        from tessella.operators.position import with_position

        return with_position(df.withColumn("__u", self._u()), ["__u", self.key], out).drop("__u")


def strings(spark: SparkSession, n: int, low: int, high: int, seed: int = 0, letters: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> DataFrame:
    """(pos, text) of random letters, lengths uniform in [low, high)."""
    size = (F.floor(unit(F.col("pos"), seed) * (high - low)) + low).cast("int")
    pick = lambda i: F.substring(F.lit(letters), (F.pmod(F.xxhash64("pos", i, F.lit(seed)), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    made = F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(1), size), pick), "")).otherwise("")
    return spark.range(n).select(F.col("id").alias("pos")).withColumn("text", made)
