"""Labels, grouped differences, quantiles along an axis and match positions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import strings, times
from tessella.operators import frame, labels, stats
from tessella.plans.registry import query
from tessella.session import table


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def q_index_argsort(spark, d):
    return labels.index(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"]).argsort()


@query("SELECT row_number() OVER (ORDER BY o_custkey DESC, o_orderdate DESC, o_orderkey) - 1 AS pos, o_custkey, o_orderdate FROM orders")
def q_multiindex_sort_values(spark, d):
    return labels.index(table(spark, d, "orders"), ["o_custkey", "o_orderdate"], ["o_orderkey"]).sort_values(ascending=False).to_frame()


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS isin FROM orders")
def q_index_lookup(spark, d):
    poor = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return labels.index(table(spark, d, "orders"), "o_custkey", ["o_orderkey"]).lookup(poor)


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, n_name AS c_nationkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_name < 'M'")
def q_index_map(spark, d):
    names = table(spark, d, "nation").where("n_name < 'M'").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return labels.index(table(spark, d, "customer"), "c_nationkey", ["c_custkey"]).map(names).to_frame()


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS pos, s_nationkey AS k FROM supplier), b AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_nationkey AS k FROM customer)
SELECT pos, s_nationkey, coalesce(s_nationkey = other, false) AS eq FROM (
  SELECT c.pos, c.k AS s_nationkey, x.k AS other FROM (SELECT * FROM a UNION ALL SELECT pos + (SELECT count(*) FROM a), k FROM b) c LEFT JOIN b x USING (pos))""")
def q_index_concat_eq(spark, d):
    a, b = labels.index(table(spark, d, "supplier"), "s_nationkey", ["s_suppkey"]), labels.index(table(spark, d, "customer"), "c_nationkey", ["c_custkey"])
    both = a.concat(b)
    return both.to_frame().join(both.eq(b), "pos")


@query("SELECT (row_number() OVER (ORDER BY p_partkey) - 1 - 3) // 4 AS pos, p_brand FROM part QUALIFY row_number() OVER (ORDER BY p_partkey) - 1 >= 3 AND (row_number() OVER (ORDER BY p_partkey) - 1 - 3) % 4 = 0")
def q_index_slice(spark, d):
    return labels.index(table(spark, d, "part"), "p_brand", ["p_partkey"])[3::4].to_frame()


@query("""WITH e AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events)
SELECT user_id, round(sum(x), 4) AS s, count(x) AS n, round(avg(x), 6) AS mean, round(var_samp(x), 4) AS var, round(stddev_samp(x), 4) AS std, min(x) AS lo, max(x) AS hi, round(median(x), 6) AS med, count(DISTINCT x) AS kinds,
  arg_min(x, event_id) FILTER (x IS NOT NULL) AS first, arg_max(x, event_id) FILTER (x IS NOT NULL) AS last, bool_or(x <> 0) AS any_x, bool_and(x <> 0) AS all_x
FROM e GROUP BY user_id""")
def q_diff_reductions(spark, d):
    """All reductions over differences of consecutive rows of a group."""
    groups = frame.Groups(table(spark, d, "events"), ["user_id"], ["event_id"])
    out = groups.diffs("value").agg(s="sum", n="count", mean="mean", var="var", std="std", lo="min", hi="max", med="median", kinds="nunique", first="first", last="last", any_x="any", all_x="all")
    rounded = {"s": 4, "mean": 6, "var": 4, "std": 4, "med": 6}
    nan = lambda x: F.when(~F.isnan(x), F.col(x))
    return out.withColumns({k: F.round(nan(k) if k in ("var", "std") else k, n) for k, n in rounded.items()})


@query("""WITH g AS (SELECT l_suppkey AS k, list_sort(list(l_extendedprice)) AS s, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, q * (n - 1) AS h FROM g, (VALUES (0.1::DOUBLE), (0.5), (0.9)) t(q)),
x AS (SELECT k, q, h, s[CAST(floor(h) AS BIGINT) + 1] AS lo, s[CAST(ceil(h) AS BIGINT) + 1] AS hi FROM p)
SELECT k, q, round(lo + (hi - lo) * (h - floor(h)), 6) AS value, 'linear' AS method FROM x UNION ALL SELECT k, q, round(lo, 6), 'lower' FROM x""")
def q_quantile_along_axis(spark, d):
    lines = table(spark, d, "lineitem")
    both = [stats.grouped_quantiles(lines, ["l_suppkey"], "l_extendedprice", [0.1, 0.5, 0.9], m).withColumn("method", F.lit(m)) for m in ("linear", "lower")]
    return both[0].unionByName(both[1]).select(F.col("l_suppkey").alias("k"), "q", F.round("value", 6).alias("value"), "method")


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '[aeiou]', '*'), '[aeiou]', '*') AS two, instr(url, regexp_extract(url, '[0-9]+')) - 1 AS start, instr(url, regexp_extract(url, '[0-9]+')) - 1 + length(regexp_extract(url, '[0-9]+')) AS stop,
  regexp_extract(url, '[0-9]+') AS found FROM pages WHERE regexp_matches(url, '[0-9]')""")
def q_match_spans(spark, d):
    span = strings.find_match("url", "[0-9]+")
    pages = table(spark, d, "pages").select("page_id", strings.sub("url", "[aeiou]", "*", 2).alias("two"), span.alias("m")).where("m is not null")
    return pages.select("page_id", "two", "m.start", F.col("m.end").alias("stop"), F.col("m.text").alias("found"))


@query("SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS pos, t FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-27', TIMESTAMP '2024-03-05', INTERVAL 7 HOUR)) AS t) WHERE t > TIMESTAMP '2024-02-27'")
def q_date_range_to_end(spark, d):
    return times.date_range(spark, "2024-02-27 15:30:00", freq="7h", end="2024-03-05", normalize=True, inclusive="right")


@query("SELECT event_id, value, CASE WHEN event_type = 'click' THEN -1 ELSE value END AS after FROM events WHERE value > 20")
def q_series_loc(spark, d):
    """Labels by a table, and assignment at labels."""
    events = table(spark, d, "events")
    s = frame.Frame(events.select("event_id", "value"), "event_id")["value"]
    some = s.loc(events.where("value > 20").select("event_id"))
    new = some.set_loc(events.where("event_type = 'click'").select("event_id"), -1.0)
    return some.df.join(new.df.withColumnRenamed("value", "after"), "event_id").select("event_id", "value", "after")
