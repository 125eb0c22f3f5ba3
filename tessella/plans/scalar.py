"""Element-wise queries: arithmetic, bits, strings, regular expressions, times, ragged rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import bits, ragged, strings, times
from tessella.functions import math as m
from tessella.plans.registry import query
from tessella.session import table

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
TOP = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"


def _long(**columns):
    return [c.cast("long").alias(k) for k, c in columns.items()]


def _six(**columns):
    return [F.round(c, 6).alias(k) for k, c in columns.items()]


@query(f"""SELECT {TOP}, round(l_extendedprice / (l_quantity - 10.37::DOUBLE), 6) AS ratio,
  CAST(floor(l_partkey / 7.0) AS BIGINT) AS fdiv, CAST(l_partkey % 7 AS BIGINT) AS fmod7, CAST(0 AS BIGINT) AS fdiv0,
  CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE floor(-l_partkey / (l_linenumber - 1.0)) END AS BIGINT) AS fdiv_neg,
  CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE ((-l_partkey) % (l_linenumber - 1) + (l_linenumber - 1)) % (l_linenumber - 1) END AS BIGINT) AS mod_neg,
  CAST(l_suppkey * l_suppkey AS BIGINT) AS sq, round(l_quantity ^ 1.5, 4) AS pow15, round(l_extendedprice - 30000, 2) AS diff, -l_quantity AS neg FROM lineitem""")
def q_arith(spark, d):
    df = table(spark, d, "lineitem")
    part, line = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    r = m.true_divide("l_extendedprice", F.col("l_quantity") - 10.37)
    return df.select(
        *LINE, F.round(r, 6).alias("ratio"),
        *_long(fdiv=m.floor_divide(part, F.lit(7)), fmod7=m.mod(part, F.lit(7)), fdiv0=m.floor_divide(part, F.lit(0)), fdiv_neg=m.floor_divide(-part, line - 1), mod_neg=m.mod(-part, line - 1), sq=m.square("l_suppkey")),
        F.round(m.power("l_quantity", 1.5), 4).alias("pow15"), F.round(F.col("l_extendedprice") - 30000, 2).alias("diff"), (-F.col("l_quantity")).alias("neg"),
    )


@query("""SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_p, round(log10(o_totalprice), 6) AS log10_p, round(log2(o_totalprice), 6) AS log2_p, round(ln(1 + o_totalprice), 6) AS log1p_p,
  round(sqrt(o_totalprice), 6) AS sqrt_p, round(exp(o_totalprice / 1e6), 6) AS exp_p, round(exp(o_totalprice / 1e6) - 1, 6) AS expm1_p, round(abs(o_totalprice - 1e5), 6) AS abs_p,
  CAST(sign(o_totalprice - 1e5) AS DOUBLE) AS sign_p, floor(o_totalprice) AS floor_p, ceil(o_totalprice) AS ceil_p, trunc(o_totalprice - 1e5) AS trunc_p FROM orders""")
def q_math_log(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey",
        *_six(log_p=m.log(p), log10_p=m.log10(p), log2_p=m.log2(p), log1p_p=m.log1p(p), sqrt_p=m.sqrt(p), exp_p=m.exp(p / 1e6), expm1_p=m.expm1(p / 1e6), abs_p=m.fabs(p - 1e5)),
        m.sign(p - 1e5).alias("sign_p"), m.floor(p).alias("floor_p"), m.ceil(p).alias("ceil_p"), m.trunc(p - 1e5).alias("trunc_p"),
    )


@query("""SELECT event_id, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(tan(value / 100), 6) AS t, round(asin(value / 1e4), 6) AS asin_v, round(acos(value / 1e4), 6) AS acos_v, round(atan(value), 6) AS atan_v,
  round(sinh(value / 100), 6) AS sinh_v, round(cosh(value / 100), 6) AS cosh_v, round(tanh(value / 100), 6) AS tanh_v, round(asinh(value), 6) AS asinh_v, round(acosh(value + 1), 6) AS acosh_v, round(atanh(value / 1e4), 6) AS atanh_v,
  round(atan2(value, 3), 6) AS atan2_v, round(degrees(value / 100), 6) AS deg, round(radians(value), 6) AS rad, round(sqrt(value * value + 9), 6) AS hyp FROM events WHERE value BETWEEN 0 AND 1000""")
def q_math_trig(spark, d):
    v = F.col("value")
    return table(spark, d, "events").where("value between 0 and 1000").select(
        "event_id",
        *_six(s=m.sin(v), c=m.cos(v), t=m.tan(v / 100), asin_v=m.arcsin(v / 1e4), acos_v=m.arccos(v / 1e4), atan_v=m.arctan(v), sinh_v=m.sinh(v / 100), cosh_v=m.cosh(v / 100), tanh_v=m.tanh(v / 100), asinh_v=m.arcsinh(v), acosh_v=m.arccosh(v + 1), atanh_v=m.arctanh(v / 1e4), atan2_v=m.arctan2(v, F.lit(3)), deg=m.rad2deg(v / 100), rad=m.deg2rad(v), hyp=m.hypot(v, F.lit(3))),
    )


@query(f"""SELECT {TOP}, CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE l_discount END AS w, CASE WHEN l_quantity < 10 THEN 10 WHEN l_quantity > 40 THEN 40 ELSE l_quantity END AS clipped,
  least(l_quantity, l_tax * 500) AS lo, greatest(l_quantity, l_tax * 500) AS hi, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE l_tax END AS masked FROM lineitem""")
def q_conditionals(spark, d):
    return table(spark, d, "lineitem").select(
        *LINE, m.where(F.col("l_quantity") > 25, "l_extendedprice", "l_discount").alias("w"), m.clip("l_quantity", 10.0, 40.0).alias("clipped"),
        m.minimum("l_quantity", F.col("l_tax") * 500).alias("lo"), m.maximum("l_quantity", F.col("l_tax") * 500).alias("hi"), m.putmask("l_tax", F.col("l_returnflag") == "R", F.lit(-1.0)).alias("masked"),
    )


@query("""SELECT o_orderkey, CAST(bit_count(o_orderkey) AS BIGINT) AS pop, CAST(bit_count(o_orderkey) % 2 AS BIGINT) AS par, CAST(64 - length(ltrim(CAST(o_orderkey::BIT AS VARCHAR), '0')) AS BIGINT) AS clz,
  CAST(length(CAST(o_orderkey::BIT AS VARCHAR)) - length(rtrim(CAST(o_orderkey::BIT AS VARCHAR), '0')) AS BIGINT) AS ctz, CAST(o_orderkey << 3 AS BIGINT) AS shl, CAST(o_orderkey >> 3 AS BIGINT) AS shr,
  CAST(o_orderkey & 1023 AS BIGINT) AS a, CAST(o_orderkey | 1023 AS BIGINT) AS o, CAST(xor(o_orderkey, o_custkey) AS BIGINT) AS x, CAST((o_orderkey >> 2) & 15 AS BIGINT) AS part,
  CAST(-o_orderkey - 1 AS BIGINT) AS inv, CAST(o_orderkey << 7 AS BIGINT) AS rot FROM orders""")
def q_bits(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey",
        *_long(pop=bits.popcount(k), par=bits.parity(k), clz=bits.clz(k), ctz=bits.ctz(k), shl=bits.left_shift(k, F.lit(3)), shr=bits.right_shift(k, F.lit(3)), a=bits.bit_and(k, F.lit(1023)), o=bits.bit_or(k, F.lit(1023)), x=bits.bit_xor(k, "o_custkey"), part=bits.slice_bits(k, 2, 5), inv=bits.invert(k), rot=bits.rotl(k, F.lit(7))),
    )


@query("""SELECT o_orderkey, concat_ws('.', (o_orderkey * 65537 >> 24) & 255, (o_orderkey * 65537 >> 16) & 255, (o_orderkey * 65537 >> 8) & 255, (o_orderkey * 65537) & 255) AS ip,
  CAST(o_orderkey * 65537 & 4294967295 AS BIGINT) AS back, TRUE AS v4, CASE WHEN o_orderkey & 2 > 0 THEN '|' ELSE '.' END || CASE WHEN o_orderkey & 1 > 0 THEN '|' ELSE '.' END AS flags,
  CASE WHEN o_orderkey & 2 > 0 THEN 'a' ELSE '-' END || CASE WHEN o_orderkey & 1 > 0 THEN 'b' ELSE '-' END AS names FROM orders""")
def q_ip_and_flags(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", bits.ip_format(F.col("o_orderkey") * 65537).alias("ip"))
    return df.select("o_orderkey", "ip", bits.ip_parse("ip").alias("back"), bits.is_ipv4("ip").alias("v4"), bits.bit_vector("o_orderkey", 2).alias("flags"), bits.fields("o_orderkey", "ab").alias("names"))


@query("""SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS cap, CAST(octet_length(encode(c_name)) AS BIGINT) AS n,
  contains(c_name, '00') AS has, starts_with(c_name, 'Cust') AS st, ends_with(c_name, '7') AS en, regexp_full_match(c_mktsegment, '[A-Za-z]+') AS alpha, regexp_full_match(c_mktsegment, '[A-Z]+') AS isup,
  regexp_full_match(c_name, '[a-z]+') AS islo, c_name || '_' || c_mktsegment AS stuck, substr(c_name, 1, 4) AS pre, right(c_name, 3) AS suf, trim('xx' || c_name || 'x', 'x') AS stripped FROM customer""")
def q_strings(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", strings.lower("c_name").alias("lo"), strings.upper("c_mktsegment").alias("up"), strings.capitalize("c_mktsegment").alias("cap"), strings.byte_lengths("c_name").cast("long").alias("n"),
        strings.contains("c_name", "00").alias("has"), strings.startswith("c_name", "Cust").alias("st"), strings.endswith("c_name", "7").alias("en"), strings.isalpha("c_mktsegment").alias("alpha"), strings.isupper("c_mktsegment").alias("isup"),
        strings.fullmatch("c_name", "[a-z]+").alias("islo"), strings.stick("c_name", "c_mktsegment", "_").alias("stuck"), strings.get_prefixes("c_name", 4).alias("pre"), strings.get_suffixes("c_name", 3).alias("suf"),
        strings.strip(F.concat(F.lit("xx"), "c_name", F.lit("x")), "x").alias("stripped"),
    )


@query(r"""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_matches(url, '/en/') AS en, regexp_full_match(url, 'https://.*') AS full_https, regexp_matches(url, '^https') AS m,
  regexp_replace(url, '[0-9]+', '#', 'g') AS subbed, CAST(len(regexp_extract_all(url, '[0-9]+')) AS BIGINT) AS n, array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS found,
  split_part(url, '/', 3) AS host, array_to_string(string_split_regex(url, '[/.]+'), '|') AS parts FROM pages""")
def q_regex(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.coalesce(strings.group("url", "^(https?)://", 1), F.lit("")).alias("scheme"), strings.search("url", "/en/").alias("en"), strings.fullmatch("url", "https://.*").alias("full_https"), strings.match("url", "https").alias("m"),
        strings.sub("url", "[0-9]+", "#").alias("subbed"), strings.count_matches("url", "[0-9]+").cast("long").alias("n"), F.array_join(strings.findall("url", "[0-9]+"), ",").alias("found"),
        F.get(strings.split("url", "/"), F.lit(2)).alias("host"), F.array_join(strings.regex_split("url", "[/.]+"), "|").alias("parts"),
    )


@query("""SELECT p_partkey, split_part(p_type, ' ', 1) AS l1, CASE WHEN contains(p_type, ' ') THEN substr(p_type, instr(p_type, ' ') + 1) ELSE '' END AS r1_or_empty,
  CAST(len(string_split(p_type, ' ')) AS BIGINT) AS words, reverse(split_part(reverse(p_type), ' ', 1)) AS last_word FROM part""")
def q_peel(spark, d):
    left, right = strings.peel("p_type", " ", keep_partial=True)
    _, last = strings.rpeel("p_type", " ", keep_partial=True)
    return table(spark, d, "part").select("p_partkey", left.alias("l1"), right.alias("r1_or_empty"), F.size(strings.split("p_type", " ")).cast("long").alias("words"), last.alias("last_word"))


@query("""SELECT doc_id, CAST(s.start AS BIGINT) AS start, CAST(s.len AS BIGINT) AS len FROM (SELECT doc_id, unnest(list_transform(range(1, length(text) - 2), lambda i: {'start': i - 1, 'len': CASE WHEN substr(text, i, 3) = 'the' THEN 3 ELSE 0 END})) AS s FROM documents) WHERE s.len = 3""")
def q_find_locations(spark, d):
    return strings.locations(table(spark, d, "documents"), "doc_id", "text", "the").select("doc_id", *_long(start=F.col("start"), len=F.col("length")))


@query("""SELECT event_id, CAST(year(ts) AS BIGINT) AS y, CAST(month(ts) AS BIGINT) AS mo, CAST(day(ts) AS BIGINT) AS d, CAST(hour(ts) AS BIGINT) AS h, CAST(minute(ts) AS BIGINT) AS mi, CAST(second(ts) AS BIGINT) AS s,
  CAST(epoch_us(ts) % 1000000 // 1000 AS BIGINT) AS ms, CAST(epoch_us(ts) % 1000 AS BIGINT) AS us, CAST(dayofyear(ts) AS BIGINT) AS doy, CAST(isodow(ts) - 1 AS BIGINT) AS dow, CAST(week(ts) AS BIGINT) AS w,
  CAST(isoyear(ts) AS BIGINT) AS iy, (year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0 AS leap FROM events""")
def q_time_parts(spark, d):
    p, iso = times.parts("ts"), times.isocalendar("ts")
    return table(spark, d, "events").select(
        "event_id",
        *_long(y=p["year"], mo=p["month"], d=p["day"], h=p["hour"], mi=p["minute"], s=p["second"], ms=p["millisecond"], us=p["microsecond"], doy=p["dayofyear"], dow=p["dayofweek"], w=p["week"], iy=iso["year"]),
        p["is_leap_year"].alias("leap"),
    )


@query("""SELECT event_id, epoch_us(ts) - epoch_us(ts) % 3600000000 AS fl, CAST(ceil(epoch_us(ts) / 3600000000.0) AS BIGINT) * 3600000000 AS ce,
  CAST(round_even(epoch_us(ts) / 3600000000.0, 0) AS BIGINT) * 3600000000 AS ro, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS delta, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 86400000000 AS days,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) % 86400000000 // 3600000000 AS hours FROM events""")
def q_time_rounding(spark, d):
    delta = times.timedelta_us("ts", F.lit("2024-01-01").cast("timestamp"))
    c = times.components(delta)
    return table(spark, d, "events").select(
        "event_id", times.micros(times.floor("ts", "h")).alias("fl"), times.micros(times.ceil("ts", "h")).alias("ce"), times.micros(times.round_("ts", "h")).alias("ro"), delta.alias("delta"), *_long(days=c["days"], hours=c["hours"])
    )


@query("SELECT i AS pos, TIMESTAMP '2024-02-27' + to_hours(6 * i) AS t FROM range(20) r(i)")
def q_date_range(spark, d):
    return times.date_range(spark, "2024-02-27", 20, "6h")


@query("""SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w[3] AS third, w[-1] AS last, array_to_string(w[1:2], ' ') AS pre, CAST(len(list_distinct(w)) AS BIGINT) AS uniq,
  CAST(greatest(len(w) - 1, 0) AS BIGINT) AS bigrams, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS first_bigram
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def q_ragged_rows(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    grams = ragged.get_ngrams("w", 2)
    return df.select(
        "doc_id", ragged.lengths("w").cast("long").alias("n"), ragged.get_jth("w", 2).alias("third"), ragged.get_jth("w", -1).alias("last"), F.array_join(F.slice("w", 1, 2), " ").alias("pre"), ragged.nunique("w").cast("long").alias("uniq"),
        F.size(grams).cast("long").alias("bigrams"), F.array_join(F.get(grams, F.lit(0)), " ").alias("first_bigram"),
    )


@query("""SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS s, round(list_avg(embedding::DOUBLE[]), 5) AS mean, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi,
  CAST(list_position(embedding, list_min(embedding)) - 1 AS BIGINT) AS amin, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS amax, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS dot FROM embeddings""")
def q_ragged_reductions(spark, d):
    e = "embedding"
    return table(spark, d, "embeddings").select(
        "vec_id", F.round(ragged.sum_(e), 4).alias("s"), F.round(ragged.mean(e), 5).alias("mean"), ragged.min_(e).cast("double").alias("lo"), ragged.max_(e).cast("double").alias("hi"),
        *_long(amin=ragged.argmin(e), amax=ragged.argmax(e)), F.round(ragged.vecdot(e, e), 4).alias("dot"),
    )


@query("""WITH t AS (SELECT c_custkey, [c_custkey % 5, c_custkey % 3, c_custkey % 3, 7] AS a, [c_custkey % 4, 7] AS b FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS i, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS dif,
  array_to_string(list_sort(list_distinct(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x))))), ',') AS x, CAST(CASE WHEN a[1] = a[2] THEN 2 ELSE 3 END + CASE WHEN a[2] = 7 THEN -1 ELSE 0 END AS BIGINT) AS runs FROM t""")
def q_ragged_sets(spark, d):
    k = F.col("c_custkey")
    df = table(spark, d, "customer").select("c_custkey", F.array(k % 5, k % 3, k % 3, F.lit(7).cast("long")).alias("a"), F.array(k % 4, F.lit(7).cast("long")).alias("b"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return df.select("c_custkey", text(ragged.intersect("a", "b")).alias("i"), text(ragged.union("a", "b")).alias("u"), text(ragged.setdiff("a", "b")).alias("dif"), text(ragged.setxor("a", "b")).alias("x"), F.size(ragged.remove_repeats("a")).cast("long").alias("runs"))


@query("""SELECT event_id, CAST(CASE WHEN k > 50 THEN k * 2 ELSE -k END AS BIGINT) AS applied FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def q_apply(spark, d):
    """A user's Python function on Arrow batches."""
    double_or_negate = F.pandas_udf(lambda s: (s * 2).where(s > 50, -s), "long")
    return table(spark, d, "events").select("event_id", double_or_negate(F.get_json_object("props", "$.k").cast("long")).alias("applied"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 100 = 0 THEN 0.0 ELSE round((o_custkey % 100) * ln(o_totalprice), 6) END AS xly, CAST(floor(o_totalprice) AS BIGINT) AS as_int, CAST(o_orderkey AS VARCHAR) AS as_text,
  CAST(o_orderkey % 2 AS BOOLEAN) AS as_bool, abs(o_totalprice - o_totalprice * 1.000001) <= 1e-8 + 1e-5 * abs(o_totalprice * 1.000001) AS near, round_even(o_totalprice, 1) AS r1 FROM orders""")
def q_special_and_casts(spark, d):
    p, k = F.col("o_totalprice"), F.col("o_custkey") % 100
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(m.xlogy(k, p), 6).alias("xly"), m.cast(m.floor(p), "bigint").alias("as_int"), m.cast("o_orderkey", "string").alias("as_text"), m.cast(F.col("o_orderkey") % 2, "boolean").alias("as_bool"), m.isclose(p, p * 1.000001).alias("near"), m.round_even(p, 1).alias("r1")
    )
