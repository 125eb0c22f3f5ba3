"""Histograms, quantiles, correlations and tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(x: Column, low: float, high: float, bins: int) -> Column:
    """0-based bin; the last bin is closed; NULL outside."""
    i = F.floor((x - low) / (high - low) * bins)
    return F.when((x >= low) & (x <= high), F.least(i, F.lit(bins - 1))).cast("int")


def bounds(df: DataFrame, *columns: str) -> list[tuple[float, float]]:
    row = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(columns))]


def histogram(df: DataFrame, *columns: str, bins: Sequence[int] | int = 10, ranges: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """(bin_0, bin_1, ..., n) over one or more dimensions; empty bins are absent."""
    sizes = [bins] * len(columns) if isinstance(bins, int) else list(bins)
    limits = list(ranges) if ranges else bounds(df, *columns)
    limits = [(lo, hi if hi > lo else lo + 1.0) for lo, hi in limits]
    marked = df.select(*[bin_of(F.col(c).cast("double"), lo, hi, n).alias(f"bin_{i}") for i, (c, (lo, hi), n) in enumerate(zip(columns, limits, sizes, strict=True))])
    return marked.dropna().groupBy(*marked.columns).agg(F.count("*").alias("n"))


def edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / bins for i in range(bins + 1)]


#: Fixed values: (alpha, beta) of the continuous sample quantiles.
CONTINUOUS = {
    "interpolated_inverted_cdf": (0.0, 1.0), "hazen": (0.5, 0.5), "weibull": (0.0, 0.0), "linear": (1.0, 1.0),
    "median_unbiased": (1 / 3, 1 / 3), "normal_unbiased": (3 / 8, 3 / 8),
}
METHODS = (*CONTINUOUS, "lower", "higher", "midpoint", "nearest", "inverted_cdf", "averaged_inverted_cdf", "closest_observation")


def quantile_place(n: int, q: float, method: str) -> tuple[int, int, float]:
    """0-based order statistics and the weight of the second."""
    keep = lambda i: min(max(int(i), 0), n - 1)
    if method in CONTINUOUS:
        a, b = CONTINUOUS[method]
        h = n * q + a + q * (1 - a - b) - 1
        i = math.floor(h)
        return keep(i), keep(i + 1), 0.0 if h < 0 or h >= n - 1 else h - i
    h = q * (n - 1)
    if method == "lower":
        return keep(math.floor(h)), keep(math.floor(h)), 0.0
    if method == "higher":
        return keep(math.ceil(h)), keep(math.ceil(h)), 0.0
    if method == "midpoint":
        return keep(math.floor(h)), keep(math.ceil(h)), 0.5
    if method == "nearest":
        i = math.floor(h)
        up = h - i > 0.5 or (h - i == 0.5 and i % 2 == 1)
        return keep(i + up), keep(i + up), 0.0
    h = n * q
    i = math.floor(h)
    if method == "inverted_cdf":
        return keep(math.ceil(h) - 1), keep(math.ceil(h) - 1), 0.0
    if method == "averaged_inverted_cdf":
        return (keep(i - 1), keep(i), 0.5) if h == i else (keep(i), keep(i), 0.0)
    if method == "closest_observation":
        h -= 0.5
        i = math.floor(h)
        at = keep(i - 1 if h == i and i % 2 == 0 else i)  # of two as near, the one of even rank
        return at, at, 0.0
    raise ValueError(f"unknown method {method!r}")


def quantiles(df: DataFrame, column: str, qs: Sequence[float], method: str = "linear") -> DataFrame:
    """(q, value): exact, with any of the sample-quantile definitions."""
    return quantiles_by_methods(df, column, qs, [method]).select("q", "value")


def quantiles_by_methods(df: DataFrame, column: str, qs: Sequence[float], methods: Sequence[str]) -> DataFrame:
    """(method, q, value): exact, with several sample-quantile definitions from one sort.

    Equal values are counted first, so a frequent one is a single row; the order
    statistics needed by any definition are looked up in a two-level running count
    of the distinct values, which are sorted once and never gathered; only those
    found, two at most a definition and q, are put into one map.
    """
    from tessella.operators.position import running

    clean = df.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = clean.count()
    if not n:
        return df.sparkSession.createDataFrame([], "method string, q double, value double")
    places = [(method, float(q), *quantile_place(n, q, method)) for method in methods for q in qs]
    asked = df.sparkSession.createDataFrame(places, "method string, q double, lo long, hi long, w double")
    want = sorted({p for *_, lo, hi, _ in places for p in (lo, hi)})
    counted = running(clean.groupBy("v").agg(F.count("*").alias("c")), ["v"], F.col("c"), "upto")
    held = F.filter(F.array(*[F.lit(x).cast("long") for x in want]), lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("c")))
    picked = counted.select("v", F.explode(held).alias("pos")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("at"))
    low, high = F.col("at")[F.col("lo")], F.col("at")[F.col("hi")]
    return asked.crossJoin(F.broadcast(picked)).select("method", "q", (low + (high - low) * F.col("w")).alias("value"))


def _grouped_place(n: Column, q: float, method: str) -> tuple[Column, Column, Column]:
    """``quantile_place`` for a column of sizes."""
    if method in CONTINUOUS:
        a, b = CONTINUOUS[method]
        h = n * q + (a + q * (1 - a - b) - 1)
        low, up, weight = F.floor(h), F.floor(h) + 1, F.when((h < 0) | (h >= n - 1), 0.0).otherwise(h - F.floor(h))
    else:
        h = (n - 1) * q
        half = h - F.floor(h)
        near = F.floor(h) + ((half > 0.5) | ((half == 0.5) & (F.floor(h) % 2 == 1))).cast("int")
        places = {"lower": (F.floor(h), F.floor(h), 0.0), "higher": (F.ceil(h), F.ceil(h), 0.0), "midpoint": (F.floor(h), F.ceil(h), 0.5), "nearest": (near, near, 0.0)}
        if method not in places:
            raise ValueError(f"method {method!r} is for whole columns")
        low, up, weight = places[method]
    keep = lambda c: F.least(F.greatest(c.cast("long"), F.lit(0)), n - 1)
    return keep(low), keep(up), F.lit(weight) if isinstance(weight, float) else weight


def grouped_quantiles(df: DataFrame, keys: Sequence[str], column: str, qs: Sequence[float], method: str = "linear") -> DataFrame:
    """(keys, q, value): exact quantiles of every group, as along an axis of an array whose other axes are the keys.

    Equal values are counted first; one running count over (keys, value) then
    places every distinct value in its group, so no group is gathered.
    """
    from tessella.operators.position import running

    clean = df.select(*keys, F.col(column).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    counted = running(clean.groupBy(*keys, "__v").agg(F.count("*").alias("__c")), [*keys, "__v"], F.col("__c"), "__upto")
    sizes = counted.groupBy(*keys).agg(F.sum("__c").alias("__n"), F.min(F.col("__upto") - F.col("__c")).alias("__before"))
    other = sizes.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    met = counted.join(other, same).withColumn("__upto", F.col("__upto") - F.col("__before"))
    holds = lambda place: (place < F.col("__upto")) & (place >= F.col("__upto") - F.col("__c"))
    asked = [(q, *_grouped_place(F.col("__n"), q, method)) for q in qs]
    rows = F.array(*[F.struct(F.lit(float(q)).alias("q"), (F.when(holds(lo), 1 - w).otherwise(0.0) + F.when(holds(up), w).otherwise(0.0)).alias("w"), (holds(lo) | holds(up)).alias("in")) for q, lo, up, w in asked])
    shares = met.select(*keys, "__v", F.explode(F.filter(rows, lambda x: x["in"])).alias("__a")).select(*keys, "__v", "__a.q", "__a.w")
    low, high = F.min("__v"), F.max("__v")
    return shares.groupBy(*keys, "q").agg(F.when(low == high, low).otherwise(low + (high - low) * F.max_by("w", "__v")).alias("value"))


def cov_corr(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, cov, corr) of all pairs of columns, in one aggregation."""
    pairs = [(a, b) for a in columns for b in columns]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("cov"), F.corr(a, b).alias("corr")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def chisquare(df: DataFrame, observed: str, expected: str | None = None, power: float = 1.0) -> DataFrame:
    """(statistic, dof) of the Cressie-Read family: 1 Pearson, 0 likelihood ratio, -1/2 Freeman-Tukey, -1 modified log-likelihood, -2 Neyman."""
    o = F.col(observed).cast("double")
    base = df if expected else df.withColumn("__e", F.lit(df.agg(F.avg(o)).first()[0]))
    e = F.col(expected or "__e").cast("double")
    if power == 1:
        term = (o - e) * (o - e) / e
    elif power == 0:
        term = 2 * F.when(o == 0, 0.0).otherwise(o * F.ln(F.when(o > 0, o / e)))
    elif power == -1:
        term = 2 * e * F.ln(e / o)
    else:
        term = o * (F.pow(o / e, F.lit(power)) - 1) * (2 / (power * (power + 1)))
    return base.agg(F.sum(term).alias("statistic"), (F.count("*") - 1).alias("dof"))


def chisquare_pvalue(statistic: float, dof: int) -> float:
    """The upper tail by the regularised incomplete gamma function (series or continued fraction)."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def all_close(df: DataFrame, a: str, b: str, **more) -> DataFrame:
    from tessella.functions.math import isclose

    return df.agg(F.coalesce(F.min(isclose(a, b, **more)), F.lit(True)).alias("allclose"))


def array_equal(a: DataFrame, b: DataFrame, pos: str = "pos", value: str = "value") -> DataFrame:
    """One row: same length and same values at every position."""
    met = a.select(pos, F.col(value).alias("__a"), F.lit(True).alias("__ina")).join(b.select(pos, F.col(value).alias("__b"), F.lit(True).alias("__inb")), pos, "full")
    return met.agg(F.coalesce(F.min(F.coalesce("__ina", F.lit(False)) & F.coalesce("__inb", F.lit(False)) & F.col("__a").eqNullSafe(F.col("__b"))), F.lit(True)).alias("equal"))
