"""Histograms, quantiles, correlations, matrices, random columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import groupby, linalg, position, random, stats
from tessella.plans.registry import query
from tessella.session import table

HIST = "least(CAST(floor(({c} - lo) / (hi - lo) * {n}) AS INT), {n} - 1)"


@query("WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT " + HIST.format(c="l_extendedprice", n=20) + " AS bin_0, count(*) AS n FROM lineitem, b GROUP BY 1")
def q_histogram(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_extendedprice", bins=20)


@query("""SELECT least(CAST(floor(l_quantity / 50 * 5) AS INT), 4) AS bin_0, least(CAST(floor(l_discount / 0.1 * 4) AS INT), 3) AS bin_1, count(*) AS n FROM lineitem WHERE l_quantity <= 50 AND l_discount <= 0.1 GROUP BY 1, 2""")
def q_histogram2d(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_quantity", "l_discount", bins=[5, 4], ranges=[(0.0, 50.0), (0.0, 0.1)])


@query("""SELECT CAST(floor(l_quantity / 51 * 3) AS INT) AS bin_0, CAST(floor(l_discount / 0.5 * 4) AS INT) AS bin_1, CAST(floor(l_tax / 0.5 * 4) AS INT) AS bin_2, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def q_histogramdd(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_tax", bins=[3, 4, 4], ranges=[(0.0, 51.0), (0.0, 0.5), (0.0, 0.5)])


@query("""SELECT 0.1::DOUBLE AS q, round(quantile_cont(o_totalprice, 0.1), 4) AS value FROM orders UNION ALL SELECT 0.25, round(quantile_cont(o_totalprice, 0.25), 4) FROM orders
  UNION ALL SELECT 0.5, round(quantile_cont(o_totalprice, 0.5), 4) FROM orders UNION ALL SELECT 0.75, round(quantile_cont(o_totalprice, 0.75), 4) FROM orders UNION ALL SELECT 0.99, round(quantile_cont(o_totalprice, 0.99), 4) FROM orders""")
def q_quantile_linear(spark, d):
    return stats.quantiles(table(spark, d, "orders"), "o_totalprice", [0.1, 0.25, 0.5, 0.75, 0.99]).select("q", F.round("value", 4).alias("value"))


CONTINUOUS = ", ".join(f"('{k}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in stats.CONTINUOUS.items())


@query(f"""WITH s AS (SELECT list_sort(list(o_totalprice)) AS s, CAST(count(*) AS DOUBLE) AS n FROM orders), q AS (SELECT * FROM s, (VALUES (0.1::DOUBLE), (0.5), (0.9)) t(q)),
h AS (SELECT s, n, q, m AS method, n * q + a + q * (1 - a - b) - 1 AS h, 'c' AS kind FROM q, (VALUES {CONTINUOUS}) t(m, a, b)
  UNION ALL SELECT s, n, q, m, q * (n - 1), m FROM q, (VALUES ('lower'), ('higher'), ('midpoint'), ('nearest')) t(m) UNION ALL SELECT s, n, q, m, n * q, m FROM q, (VALUES ('inverted_cdf'), ('averaged_inverted_cdf')) t(m)
  UNION ALL SELECT s, n, q, 'closest_observation', n * q - 0.5, 'closest_observation' FROM q),
p AS (SELECT s, n, q, method,
  CASE kind WHEN 'higher' THEN ceil(h) WHEN 'nearest' THEN round_even(h, 0) WHEN 'inverted_cdf' THEN ceil(h) - 1 WHEN 'averaged_inverted_cdf' THEN CASE WHEN h = floor(h) THEN h - 1 ELSE floor(h) END
    WHEN 'closest_observation' THEN CASE WHEN h = floor(h) AND floor(h) % 2 = 0 THEN h - 1 ELSE floor(h) END ELSE floor(h) END AS lo,
  CASE kind WHEN 'c' THEN floor(h) + 1 WHEN 'midpoint' THEN ceil(h) WHEN 'averaged_inverted_cdf' THEN floor(h) END AS hi,
  CASE kind WHEN 'c' THEN CASE WHEN h < 0 OR h >= n - 1 THEN 0 ELSE h - floor(h) END WHEN 'midpoint' THEN 0.5 WHEN 'averaged_inverted_cdf' THEN 0.5 ELSE 0 END AS w FROM h),
v AS (SELECT q, method, w, s[CAST(greatest(least(lo, n - 1), 0) AS BIGINT) + 1] AS a, s[CAST(greatest(least(coalesce(hi, lo), n - 1), 0) AS BIGINT) + 1] AS b FROM p)
SELECT q, round(a + (b - a) * w, 6) AS value, method FROM v""")
def q_quantile_methods(spark, d):
    """All definitions of a sample quantile."""
    found = stats.quantiles_by_methods(table(spark, d, "orders"), "o_totalprice", [0.1, 0.5, 0.9], stats.METHODS)
    return found.select("q", F.round("value", 6).alias("value"), "method")


NAMES = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS cov, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in NAMES for b in NAMES))
def q_cov_corr(spark, d):
    return stats.cov_corr(table(spark, d, "lineitem"), list(NAMES)).select("a", "b", F.round("cov", 4).alias("cov"), F.round("corr", 6).alias("corr"))


@query("""WITH c AS (SELECT event_type, count(*)::DOUBLE AS o FROM events GROUP BY 1), m AS (SELECT avg(o) AS e FROM c) SELECT round(sum((o - e) * (o - e) / e), 6) AS statistic, count(*) - 1 AS dof FROM c, m""")
def q_chisquare(spark, d):
    counts = table(spark, d, "events").groupBy("event_type").count()
    return stats.chisquare(counts, "count").select(F.round("statistic", 6).alias("statistic"), "dof")


@query("SELECT round(avg(z * z * z) / pow(avg(z * z), 1.5), 5) AS skew FROM (SELECT o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS z FROM orders)")
def q_skew(spark, d):
    return table(spark, d, "orders").agg(F.round(F.skewness("o_totalprice"), 5).alias("skew"))


@query("SELECT round(sum(l_quantity * l_extendedprice), 0) AS dot FROM lineitem")
def q_dot(spark, d):
    return linalg.dot(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("dot", 0).alias("dot"))


E = "WITH e AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings) "


@query(E + "SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(sum(a.v * b.v), 4) AS v FROM e a JOIN e b USING (i) GROUP BY 1, 2")
def q_gram(spark, d):
    return linalg.gram(table(spark, d, "embeddings"), "vec_id", "embedding").select(F.col("i").cast("long"), F.col("j").cast("long"), F.round("v", 4).alias("v"))


@query(E + "SELECT CAST(a.j AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, round(sum(a.v * b.v), 4) AS v FROM e a JOIN e b USING (i) WHERE b.j <= a.j GROUP BY 1, 2")
def q_matmul_tril_whole(spark, d):
    m = linalg.from_rows(table(spark, d, "embeddings"), "vec_id", "embedding")
    return linalg.tril(linalg.matmul(linalg.transpose(m), m)).select("i", "j", F.round("v", 4).alias("v"))


@query("SELECT CAST(l_suppkey AS BIGINT) AS i, CAST(sum(c) OVER (ORDER BY l_suppkey) - c AS BIGINT) AS start, CAST(c AS BIGINT) AS n FROM (SELECT l_suppkey, count(DISTINCT l_partkey % 50) AS c FROM lineitem GROUP BY 1)")
def q_sparse_csr(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 50).alias("j"), F.lit(1.0).alias("v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return linalg.csr(m).select("i", F.col("start").cast("long"), F.size("cols").cast("long").alias("n"))


@query()
def q_random(spark, d):
    g = random.Generator(11)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pos")).select("pos", g.random().alias("u"), g.integers(0, 10).alias("k"), g.standard_normal().alias("z"), g.exponential(2.0).alias("e"), g.poisson(3.0).alias("p"), g.logistic().alias("l"), g.standard_gamma(2.5).alias("g"), g.lognormal().alias("ln"))


@query()
def q_permutation(spark, d):
    df = position.with_position(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    return random.Generator(3).permutation(df).select("c_custkey", "perm")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS kinds, 0 AS lo, count(*) - 1 AS hi, false AS same FROM customer")
def q_permutation_properties(spark, d):
    """Every row once, every place once, and not the order of the keys."""
    moved = q_permutation(spark, d).agg(F.count("*").alias("n"), F.count_distinct("perm").alias("kinds"), F.min("perm").alias("lo"), F.max("perm").alias("hi"), (F.corr("c_custkey", "perm") > 0.5).alias("same"))
    return moved.withColumn("lo", F.col("lo").cast("int"))


@query("SELECT user_id, least(count(*), 2) AS n, least(count(*), 2) AS kinds, true AS own FROM events GROUP BY user_id")
def q_group_sample_properties(spark, d):
    """Two rows of every group, or all it has; each a row of that group, and none twice."""
    events = table(spark, d, "events").select("event_id", "user_id")
    drawn = groupby.sample(events, ["user_id"], 2, 7, ["event_id"]).join(events.select("event_id", F.col("user_id").alias("whose")), "event_id", "left")
    return drawn.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("kinds"), F.min(F.coalesce(F.col("whose") == F.col("user_id"), F.lit(False))).alias("own"))


@query("SELECT true AS inside, true AS even, true AS whole, true AS centred FROM region LIMIT 1")
def q_random_properties(spark, d):
    """Draws over all lines lie in their ranges, with the means and spreads of their distributions within 2 % of the spread's scale."""
    g = random.Generator(4)
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    drawn = lines.select(g.random().alias("u"), g.integers(0, 10).alias("k"), g.standard_normal().alias("z"), g.poisson(200.0).alias("p"))
    return drawn.agg(
        ((F.min("u") > 0) & (F.max("u") < 1) & (F.min("k") == 0) & (F.max("k") == 9)).alias("inside"), (F.abs(F.avg("u") - 0.5) < 0.02).alias("even"),
        (F.abs(F.avg("p") - 200) < 1).alias("whole"), ((F.abs(F.avg("z")) < 0.05) & (F.abs(F.stddev("z") - 1) < 0.05)).alias("centred"),
    )
