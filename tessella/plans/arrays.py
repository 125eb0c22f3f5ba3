"""N-dimensional arrays and files over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import linalg
from tessella.operators.ndarray import NDArray
from tessella.plans.registry import query
from tessella.session import shared, table
from tessella.sources import io

E = "WITH e AS (SELECT CAST(vec_id AS BIGINT) AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) "


def _vectors(spark, d) -> NDArray:
    """All embeddings, by id and component."""
    m = linalg.from_rows(table(spark, d, "embeddings"), "vec_id", "embedding").select(F.col("i").cast("long").alias("i0"), F.col("j").cast("long").alias("i1"), F.col("v").cast("double").alias("v"))
    rows, width = m.agg(F.max("i0") + 1, F.max("i1") + 1).first()
    return NDArray(m, (rows or 0, width or 0))


@query(E + "SELECT j, round(sum(v), 4) AS sum, round(avg(v), 6) AS mean, min(v) AS min, max(v) AS max, round(var_pop(v), 6) AS var, arg_max(i, struct_pack(a := v, b := -i)) AS argmax, arg_min(i, struct_pack(a := v, b := i)) AS argmin, bool_or(v <> 0) AS any, bool_and(v <> 0) AS all FROM e GROUP BY j")
def q_array_axis_reductions(spark, d):
    a, out = _vectors(spark, d), None
    for kind in ("sum", "mean", "min", "max", "var", "argmax", "argmin", "any", "all"):
        one = getattr(a, kind)(0).df.select(F.col("i0").alias("j"), F.col("v").alias(kind))
        out = one if out is None else out.join(one, "j")
    return out.withColumns({"sum": F.round("sum", 4), "mean": F.round("mean", 6), "var": F.round("var", 6)})


@query(E + "SELECT i, j, round(sum(v) OVER (PARTITION BY j ORDER BY i), 5) AS v FROM e")
def q_array_cumulative_sum(spark, d):
    return _vectors(spark, d).cumulative_sum(0).df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.round("v", 5).alias("v"))


@query(E + "SELECT j, round(median(v), 6) AS median, round(quantile_cont(v, 0.9), 6) AS high FROM e GROUP BY j")
def q_array_quantiles(spark, d):
    a = _vectors(spark, d)
    low, high = a.median(0).df, a.quantile(0.9, 0).df
    return low.select(F.col("i0").alias("j"), F.round("v", 6).alias("median")).join(high.select(F.col("i0").alias("j"), F.round("v", 6).alias("high")), "j")


@query(E + "SELECT (j + 3) % (SELECT max(j) + 1 FROM e) AS i, (SELECT max(i) FROM e) - i AS j, round(2 * v + 1, 6) AS v FROM e")
def q_array_moves(spark, d):
    """Transposed, rolled, turned round, scaled."""
    a = _vectors(spark, d).permute_dims([1, 0]).roll(3, 0).flip(1) * 2.0 + 1.0
    return a.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.round("v", 6).alias("v"))


@query(E + ", w AS (SELECT max(j) + 1 AS w FROM e) SELECT i * w + j AS i, v FROM e, w UNION ALL SELECT (SELECT count(*) FROM e) + i * w + j, -v FROM e, w")
def q_array_reshape_concat(spark, d):
    a = _vectors(spark, d)
    flat = a.reshape(a.size)
    return flat.concat(-flat).df.select(F.col("i0").alias("i"), "v")


@query("SELECT n_name AS v, CAST(dense_rank() OVER (ORDER BY n_name) - 1 AS BIGINT) AS code, CAST(min(c_custkey) AS BIGINT) AS first, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def q_array_unique_all(spark, d):
    """Distinct values with code, first place and count; places are customer keys here."""
    names = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("long").alias("i0"), F.col("n_name").alias("v"))
    n = names.agg(F.max("i0") + 1).first()[0] or 0
    return NDArray(names, (n,)).unique_all()[0].select("v", "code", "first", "n")


def _round_trip(spark, d, kind: str):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = f"{shared(spark)}/trip-{kind}"
    io.write(df, path, kind, mode="overwrite", compression=None, **({"header": "true"} if kind == "csv" else {}))
    return io.read(spark, path, kind, schema=df.schema, **({"header": "true"} if kind == "csv" else {}))


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@query(ORDERS)
def q_io_parquet(spark, d):
    return _round_trip(spark, d, "parquet")


@query(ORDERS)
def q_io_csv(spark, d):
    return _round_trip(spark, d, "csv")


@query(ORDERS)
def q_io_json(spark, d):
    return _round_trip(spark, d, "json")


@query(ORDERS)
def q_io_orc(spark, d):
    return _round_trip(spark, d, "orc")
