"""Grouping, joins, sets, order and frames over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import times
from tessella.operators import categorical, create, frame, groupby, joins, position, sets
from tessella.plans.registry import query
from tessella.session import table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def q_pricing_summary(spark, d):
    """Filter, arithmetic projection, two-key grouping and sort."""
    lines = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = groupby.aggregate(lines, ["l_returnflag", "l_linestatus"], {"sum_qty": ("sum", "l_quantity"), "sum_net": ("sum", "net"), "avg_qty": ("mean", "l_quantity"), "n": ("size", None)})
    return out.select("l_returnflag", "l_linestatus", F.round("sum_qty", 2).alias("sum_qty"), F.round("sum_net", 2).alias("sum_net"), F.round("avg_qty", 6).alias("avg_qty"), "n").orderBy("l_returnflag", "l_linestatus")


@query("""WITH e AS (SELECT *, event_id % 7 AS k FROM events)
SELECT event_type, count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS var, round(stddev_samp(value), 4) AS std, min(value) AS lo, max(value) AS hi, round(median(value), 6) AS med,
  count(DISTINCT user_id) AS users, bool_or(value > 100) AS any_v, bool_and(value > 0) AS all_v, CAST(bit_or(k) AS BIGINT) AS o, CAST(bit_and(user_id) AS BIGINT) AS a, CAST(bit_xor(event_id) AS BIGINT) AS x,
  arg_min(value, event_id) AS first_v, arg_max(value, event_id) AS last_v, min({'v': value, 'id': event_id}).id AS amin, max({'v': value, 'id': -event_id}).id * -1 AS amax, array_to_string(list_sort(list(DISTINCT k)), ',') AS uniq, round(product(1 + value / 1e6), 6) AS prod
FROM e GROUP BY event_type""")
def q_group_all_reductions(spark, d):
    df = table(spark, d, "events").withColumns({"k": F.col("event_id") % 7, "over": F.col("value") > 100, "pos": F.col("value") > 0, "small": 1 + F.col("value") / 1e6})
    asked = {
        "n": ("size", None), "s": ("sum", "value"), "mean": ("mean", "value"), "var": ("var", "value"), "std": ("std", "value"), "lo": ("min", "value"), "hi": ("max", "value"), "med": ("median", "value"), "users": ("nunique", "user_id"),
        "any_v": ("any", "over"), "all_v": ("all", "pos"), "o": ("or", "k"), "a": ("and", "user_id"), "x": ("xor", "event_id"), "first_v": ("first", "value"), "last_v": ("last", "value"), "amin": ("argmin", "value"), "amax": ("argmax", "value"), "uniq": ("unique", "k"), "prod": ("prod", "small"),
    }
    out = groupby.aggregate(df, ["event_type"], asked, ["event_id"])
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select(
        "event_type", "n", r("s", 2), r("mean", 6), r("var", 4), r("std", 4), "lo", "hi", r("med", 6), "users", "any_v", "all_v", "o", "a", "x", "first_v", "last_v",
        F.col("amin.event_id").alias("amin"), F.col("amax.event_id").alias("amax"), F.array_join(F.col("uniq").cast("array<string>"), ",").alias("uniq"), r("prod", 6),
    )


@query("""SELECT user_id, min(event_type) AS mode FROM (SELECT user_id, event_type, count(*) AS n, max(count(*)) OVER (PARTITION BY user_id) AS top FROM events GROUP BY 1, 2) WHERE n = top GROUP BY 1""")
def q_group_mode(spark, d):
    return groupby.mode(table(spark, d, "events"), ["user_id"], "event_type")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 3")
def q_group_head(spark, d):
    return groupby.head(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 3)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2")
def q_group_tail(spark, d):
    return groupby.head(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 2, last=True)


@query()
def q_group_sample(spark, d):
    return groupby.sample(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], 2, 7, ["event_id"])


@query("SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS diff FROM events")
def q_group_diff(spark, d):
    return position.diff(table(spark, d, "events"), ["event_id"], "value", partition_by=["user_id"]).select("event_id", "user_id", F.round("diff", 6).alias("diff"))


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id), 6) AS mean, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def q_group_broadcast(spark, d):
    out = groupby.broadcast_back(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], {"mean": ("mean", "value"), "n": ("size", None)})
    return out.select("event_id", "user_id", F.round("mean", 6).alias("mean"), "n")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) BETWEEN 50 AND 80)")
def q_filter_by_range(spark, d):
    return groupby.filter_by_range(table(spark, d, "events").select("event_id", "user_id"), ["user_id"], 50, 80)


@query("SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS code FROM customer")
def q_group_codes(spark, d):
    return groupby.codes(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS hi, min(l_tax) AS lo, round(stddev_samp(l_quantity), 6) AS std, count(DISTINCT l_suppkey) AS supp FROM lineitem")
def q_whole_reductions(spark, d):
    out = groupby.whole(table(spark, d, "lineitem"), {"n": ("size", None), "s": ("sum", "l_quantity"), "mean": ("mean", "l_extendedprice"), "hi": ("max", "l_extendedprice"), "lo": ("min", "l_tax"), "std": ("std", "l_quantity"), "supp": ("nunique", "l_suppkey")})
    return out.select("n", F.round("s", 2).alias("s"), F.round("mean", 4).alias("mean"), "hi", "lo", F.round("std", 6).alias("std"), "supp")


def _whole_sides(spark, d):
    """Whole tables; some events have no lines, some lines no event."""
    left = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("n"), "value")
    right = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"))
    return left, right


WHOLE_SIDES = "WITH l AS (SELECT event_id AS key, user_id AS n, value FROM events), r AS (SELECT l_orderkey AS key, l_linenumber AS n, l_extendedprice AS price FROM lineitem) "


@query(WHOLE_SIDES + "SELECT key, l.n AS n_x, value, r.n AS n_y, price FROM l JOIN r USING (key)")
def q_merge_inner_whole(spark, d):
    return joins.merge(*_whole_sides(spark, d), on="key")


@query(WHOLE_SIDES + "SELECT key, l.n AS n_x, value, CAST(r.n AS DOUBLE) AS n_y, price FROM l LEFT JOIN r USING (key)")
def q_merge_left_whole(spark, d):
    return joins.merge(*_whole_sides(spark, d), on="key", how="left")


@query(WHOLE_SIDES + "SELECT key, CAST(l.n AS DOUBLE) AS n_x, value, r.n AS n_y, price FROM l RIGHT JOIN r USING (key)")
def q_merge_right_whole(spark, d):
    return joins.merge(*_whole_sides(spark, d), on="key", how="right")


@query(WHOLE_SIDES + "SELECT key, CAST(l.n AS DOUBLE) AS n_x, value, CAST(r.n AS DOUBLE) AS n_y, price FROM l FULL JOIN r USING (key)")
def q_merge_outer_whole(spark, d):
    return joins.merge(*_whole_sides(spark, d), on="key", how="outer")


@query("SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def q_semi(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.semi(table(spark, d, "customer"), big, ["c_custkey"])


@query("SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_anti(spark, d):
    return joins.semi(table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"], invert=True)


@query("SELECT s_suppkey, s_nationkey, (s_suppkey, s_nationkey) IN (SELECT c_custkey, c_nationkey FROM customer) AS isin FROM supplier")
def q_in1d_two_columns(spark, d):
    other = table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"))
    return joins.isin(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), other, ["s_suppkey", "s_nationkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 40 * p_retailprice")
def q_inner_join_where(spark, d):
    out = joins.inner_join(table(spark, d, "lineitem"), table(spark, d, "part"), "l_partkey", "p_partkey", lambda a, b: a["l_extendedprice"] > 40 * b["p_retailprice"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "p_retailprice")


DT = "WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'click'), f AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'error') SELECT e.event_id AS left_id, f.event_id AS right_id FROM e JOIN f USING (user_id) WHERE "


def _dt(spark, d, predicate):
    df = table(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(times.micros("ts") / 1_000_000).alias("t"))
    out = joins.join_on_eq_with_dt(df.where("event_type = 'click'"), df.where("event_type = 'error'"), "user_id", "t", "t", 3600, predicate)
    return out.select(F.col("left_event_id").alias("left_id"), F.col("right_event_id").alias("right_id"))


@query(DT + "TRUE")
def q_join_dt_true(spark, d):
    return _dt(spark, d, "true_dt")


@query(DT + "abs(f.t - e.t) <= 3600")
def q_join_dt_abs(spark, d):
    return _dt(spark, d, "abs_dt")


@query(DT + "f.t - e.t BETWEEN 0 AND 3600")
def q_join_dt_pos(spark, d):
    return _dt(spark, d, "pos_dt")


@query("SELECT doc_id, coalesce(CAST(quality AS BIGINT), -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def q_lookup_whole(spark, d):
    """Labels cover some of the documents."""
    keys = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    return joins.lookup(table(spark, d, "documents").select("doc_id"), keys, ["doc_id"], "quality", F.lit(-1).cast("long")).select("doc_id", "quality")


@query("SELECT o_orderkey, o_totalprice, coalesce((SELECT CAST(min(i) AS BIGINT) FROM range(0, 20) r(i) WHERE o_totalprice BETWEEN i * 25000.0 AND i * 25000.0 + 15000), -1) AS bin FROM orders")
def q_interval_lookup(spark, d):
    bins = spark.range(20).select(F.col("id").alias("bin"), (F.col("id") * 25000.0).alias("low"), (F.col("id") * 25000.0 + 15000).alias("high"))
    return joins.interval_lookup(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bins, "o_totalprice", "bin", F.lit(-1).cast("long")).select("o_orderkey", "o_totalprice", "bin")


@query("SELECT c_nationkey, CAST(min(c_custkey) AS BIGINT) AS c_custkey FROM customer GROUP BY 1")
def q_find_first(spark, d):
    df = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return joins.find(df, df, ["c_nationkey"], "c_custkey")


PRICES, LINE_PRICES = "SELECT o_totalprice AS v FROM orders", "SELECT l_extendedprice AS v FROM lineitem"


def _prices(spark, d):
    """Two whole columns that overlap in part."""
    return table(spark, d, "orders").select(F.col("o_totalprice").alias("v")), table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("v"))


@query(f"{PRICES} UNION {LINE_PRICES}")
def q_set_union_whole(spark, d):
    return sets.union(*_prices(spark, d))


@query(f"{PRICES} INTERSECT {LINE_PRICES}")
def q_set_intersect_whole(spark, d):
    return sets.intersect(*_prices(spark, d))


@query(f"{LINE_PRICES} EXCEPT {PRICES}")
def q_set_diff_whole(spark, d):
    a, b = _prices(spark, d)
    return sets.setdiff(b, a)


@query(f"({PRICES} EXCEPT {LINE_PRICES}) UNION ({LINE_PRICES} EXCEPT {PRICES})")
def q_set_xor_whole(spark, d):
    return sets.setxor(*_prices(spark, d))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def q_set_intersect_2col(spark, d):
    df = table(spark, d, "lineitem")
    return sets.intersect(df.where("l_quantity > 45").select("l_partkey", "l_suppkey"), df.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def q_value_counts(spark, d):
    return sets.value_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("SELECT arg_min(event_id, event_id) AS event_id, user_id, event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def q_drop_duplicates_first(spark, d):
    return sets.drop_duplicates(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], ["event_id"])


@query("SELECT arg_max(event_id, event_id) AS event_id, user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def q_drop_duplicates_last(spark, d):
    return sets.drop_duplicates(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["user_id", "event_type"], ["event_id"], "last")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS rank, o_orderkey FROM orders")
def q_argsort(spark, d):
    return position.argsort(table(spark, d, "orders"), ["o_orderdate"], "o_orderkey")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderpriority, o_totalprice, o_orderkey) - 1 AS BIGINT) AS rank, o_orderkey FROM orders")
def q_coargsort(spark, d):
    return position.argsort(table(spark, d, "orders"), ["o_orderpriority", "o_totalprice"], "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q_topk(spark, d):
    return position.top_k(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100, ties=["o_orderkey"])


@query("SELECT v AS x, (SELECT count(*) FROM orders WHERE o_totalprice < v) AS slot FROM (SELECT i * 10000.0::DOUBLE AS v FROM range(0, 60) r(i))")
def q_searchsorted(spark, d):
    values = spark.range(60).select((F.col("id") * 10000.0).alias("x"))
    return position.searchsorted(table(spark, d, "orders"), values, "o_totalprice", "x").select("x", F.col("slot").cast("long").alias("slot"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 2) AS cumsum, max(value) OVER (ORDER BY event_id) AS cummax FROM events")
def q_cumsum(spark, d):
    df = position.running_values(table(spark, d, "events").select("event_id", "value"), ["event_id"], {"cumsum": ("sum", F.col("value")), "cummax": ("max", F.col("value"))})
    return df.select("event_id", F.round("cumsum", 2).alias("cumsum"), "cummax")


@query("SELECT event_id, user_id, round(exp(sum(ln(1 + value / 1e6)) OVER (PARTITION BY user_id ORDER BY event_id)), 6) AS cumprod FROM events")
def q_cumprod(spark, d):
    df = position.running(table(spark, d, "events"), ["event_id"], 1 + F.col("value") / 1e6, "cumprod", "product", ["user_id"])
    return df.select("event_id", "user_id", F.round("cumprod", 6).alias("cumprod"))


@query("SELECT event_id, round(value - lag(value) OVER (ORDER BY event_id), 6) AS diff FROM events")
def q_diff(spark, d):
    return position.diff(table(spark, d, "events").select("event_id", "value"), ["event_id"], "value").select("event_id", F.round("diff", 6).alias("diff"))


@query("SELECT event_id, lag(user_id, 3) OVER (ORDER BY event_id) AS shifted FROM events")
def q_shift(spark, d):
    return position.shift(table(spark, d, "events").select("event_id", "user_id"), ["event_id"], "user_id", 3).select("event_id", "shifted")


@query("SELECT bool_and(ok) AS is_sorted FROM (SELECT coalesce(event_id >= lag(event_id) OVER (ORDER BY event_id), TRUE) AS ok FROM events)")
def q_is_sorted(spark, d):
    return position.is_sorted(table(spark, d, "events"), ["event_id"], "event_id")


@query("SELECT CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS index, o_orderkey, o_totalprice FROM orders")
def q_gather_whole(spark, d):
    """The whole table in the order of another column."""
    df = position.with_position(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    asked = position.argsort(df, ["o_totalprice"]).select(F.col("rank").alias("n"), F.col("pos").alias("index"))
    return position.gather(df, asked).select(F.col("n").alias("index"), "o_orderkey", "o_totalprice")


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 100 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def q_scatter(spark, d):
    df = position.with_position(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return position.scatter(df, spark.range(100).select(F.col("id").alias("pos"), F.lit(-1.0).alias("new")), "o_totalprice").select("pos", "o_totalprice")


@query("SELECT n_nationkey, CAST(i AS BIGINT) AS value FROM nation, range(0, 30) r(i) WHERE i >= n_regionkey AND i < n_nationkey")
def q_gen_ranges(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("a"), F.col("n_nationkey").cast("long").alias("b"))
    return position.generate_ranges(df, "a", "b").select("n_nationkey", "value")


@query("SELECT n_nationkey, CAST(i AS BIGINT) AS copy FROM nation, range(0, 10) r(i) WHERE i < n_regionkey")
def q_repeat(spark, d):
    return position.repeat(table(spark, d, "nation"), F.col("n_regionkey")).select("n_nationkey", F.col("copy").cast("long").alias("copy"))


@query("SELECT CAST(i AS BIGINT) AS pos, CAST(CASE WHEN i < 10 THEN 5 + 3 * i ELSE 5 + 3 * (19 - i) END AS BIGINT) AS value FROM range(0, 20) r(i)")
def q_array_construction(spark, d):
    a = create.arange(spark, 5, 35, 3)
    return create.hstack(a, create.flip(a))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment LIKE '%U%' OR c_mktsegment LIKE '%u%' GROUP BY 1")
def q_categorical(spark, d):
    cat = categorical.Categorical.of(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    hit = cat.matching(F.lower("category").contains("u"))
    return categorical.Categorical(hit, cat.categories, cat.column).counts()


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN (SELECT min(c_mktsegment) FROM customer UNION SELECT max(c_mktsegment) FROM customer) THEN c_mktsegment END AS c_mktsegment FROM customer")
def q_categorical_set(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    ends = df.agg(F.min("c_mktsegment").alias("a"), F.max("c_mktsegment").alias("b")).first()
    return categorical.Categorical.of(df, "c_mktsegment").set_categories([ends.a, ends.b]).to_strings().select("c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, o_totalprice, round(o_totalprice / 1000, 6) AS k FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i BETWEEN 10 AND 59")
def q_frame_slice(spark, d):
    f = frame.Frame.of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return f[10:60].assign(k=F.round(F.col("o_totalprice") / 1000, 6)).df.drop("index")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def q_frame_groupby(spark, d):
    f = frame.Frame.of(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderkey"])
    return f.groupby("o_orderpriority").sum("o_totalprice").select("o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS value FROM events")
def q_frame_fillna(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return frame.Frame(df, "event_id").fillna(0.0).df


@query("SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def q_windowed_events(spark, d):
    """The batch form of the streaming extension."""
    from tessella.streaming import windows

    return windows.windowed(table(spark, d, "events"), "ts", ["user_id"], "value", "1 hour").select("user_id", "start", "n", F.round("total", 2).alias("total"))


@query("""SELECT e.event_id, f.value AS last_error FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') f ON e.user_id = f.user_id AND e.ts >= f.ts""")
def q_as_of(spark, d):
    df = table(spark, d, "events")
    right = df.where("event_type = 'error'").select("user_id", F.col("ts").alias("rt"), F.col("value").alias("last_error"))
    return joins.as_of(df.where("event_type = 'click'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "rt", "last_error").select("event_id", "last_error")
