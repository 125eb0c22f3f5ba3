import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import bits, ragged, strings, times
from tessella.functions import math as m


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_division_edges(spark):
    lit = F.lit
    r = one(spark, a=m.true_divide(lit(1), lit(0)), b=m.true_divide(lit(-1), lit(0)), c=m.true_divide(lit(0), lit(0)), d=m.floor_divide(lit(-7), lit(3)), e=m.mod(lit(-7), lit(3)), f=m.floor_divide(lit(7), lit(0)), g=m.mod(lit(7), lit(0)), h=m.float_mod(lit(-7.5), lit(2.0)), i=m.fmod(lit(-7.5), lit(2.0)))
    assert (r.a, r.b) == (math.inf, -math.inf) and math.isnan(r.c)
    assert (r.d, r.e, r.f, r.g) == (-7 // 3, -7 % 3, 0, 0)
    assert (r.h, r.i) == (-7.5 % 2.0, math.fmod(-7.5, 2.0))


def test_logarithm_edges(spark):
    r = one(spark, a=m.log(F.lit(0.0)), b=m.log(F.lit(-1.0)), c=m.log1p(F.lit(-1.0)), d=m.log2(F.lit(8.0)), e=m.log(F.lit(float("nan"))))
    assert r.a == -math.inf and math.isnan(r.b) and r.c == -math.inf and r.d == 3 and math.isnan(r.e)


@pytest.mark.parametrize("x", [1.0, 1.5, -2.0, 0.0, 1e-300, 123.456])
def test_nextafter(spark, x):
    r = one(spark, up=m.nextafter(F.lit(x)), down=m.nextafter(F.lit(x), up=False))
    assert (r.up, r.down) == (math.nextafter(x, math.inf), math.nextafter(x, -math.inf))


def test_rounding_and_clip(spark):
    r = one(spark, a=m.round_even(F.lit(2.5)), b=m.trunc(F.lit(-1.7)), c=m.clip(F.lit(5), 1, 3), d=m.minimum(F.lit(1.0), F.lit(float("nan"))), e=m.integer_power(F.lit(3), 5), f=m.xlogy(F.lit(0.0), F.lit(0.0)))
    assert (r.a, r.b, r.c, r.e, r.f) == (2, -1, 3, 243, 0) and math.isnan(r.d)


@pytest.mark.parametrize("x", [0, 1, 5, -1, 2**62, -(2**63)])
def test_bits(spark, x):
    u = x % 2**64
    r = one(spark, p=bits.popcount(F.lit(x).cast("long")), clz=bits.clz(F.lit(x)), ctz=bits.ctz(F.lit(x)), rot=bits.rotl(F.lit(x), F.lit(9)), back=bits.rotr(bits.rotl(F.lit(x), F.lit(9)), F.lit(9)), big=bits.left_shift(F.lit(x), F.lit(64)))
    turned = (u << 9 | u >> 55) % 2**64
    assert r.p == bin(u).count("1") and r.clz == 64 - u.bit_length() and r.ctz == (64 if not u else (u & -u).bit_length() - 1)
    assert r.rot % 2**64 == turned and r.back == x and r.big == 0


def test_ip_and_flags(spark):
    r = one(spark, a=bits.ip_format(F.lit(3232235777)), b=bits.ip_parse(F.lit("192.168.1.1")), c=bits.ip_parse(F.lit("1.2.3")), d=bits.bit_vector(F.lit(5), 4), e=bits.fields(F.lit(5), "abc"))
    assert tuple(r) == ("192.168.1.1", 3232235777, None, ".|.|", "a-c")


@pytest.mark.parametrize("s", ["", " ", "abc", "Abc Def", "ABC", "a1", "12", "²", "Él ça", "it's", "a-b"])
def test_string_classes(spark, s):
    c = F.lit(s)
    r = one(spark, a=strings.isalpha(c), b=strings.isdigit(c), c=strings.isalnum(c), d=strings.islower(c), e=strings.isupper(c), f=strings.isdecimal(c), g=strings.capitalize(c), h=strings.title(c), i=strings.isspace(c))
    assert tuple(r) == (s.isalpha(), s.isdigit(), s.isalnum(), s.islower(), s.isupper(), s.isdecimal(), s.capitalize(), s.title(), s.isspace())


def test_peel_and_locations(spark):
    left, right = strings.peel(F.lit("a_b_c"), "_")
    l2, r2 = strings.rpeel(F.lit("a_b_c"), "_")
    l3, r3 = strings.peel(F.lit("abc"), "_")
    r = one(spark, a=left, b=right, c=l2, d=r2, e=l3, f=r3, g=strings.find_locations(F.lit("_1__2_"), "_+"), h=strings.subn(F.lit("a1b22"), "[0-9]+", "#"))
    assert tuple(r)[:6] == ("a", "b_c", "a_b", "c", "", "abc")
    assert [tuple(x) for x in r.g] == [(0, 1), (2, 2), (5, 1)] and tuple(r.h) == ("a#b#", 2)
    found = one(spark, a=strings.findall(F.lit("aabba"), r"(\w)\1"), b=strings.find_locations(F.lit("aabba"), r"(\w)\1"), c=strings.find_locations(F.lit("ab"), "x*"), d=strings.find_locations(F.lit(""), "x"))
    assert found.a == ["aa", "bb"] and [tuple(x) for x in found.b] == [(0, 2), (2, 2)]
    assert [tuple(x) for x in found.c] == [(0, 0), (1, 0), (2, 0)] and found.d == []
    df = spark.createDataFrame([(1, "_1__2_"), (2, "x")], "k int, s string")
    assert sorted((x.k, x.start, x.length) for x in strings.locations(df, "k", "s", "_+").collect()) == [(1, 0, 1), (1, 2, 2), (1, 5, 1)]


def test_locations_read_a_text_once(spark):
    """Each text is replaced and parted once, not once for every match."""
    df = spark.createDataFrame([(1, "é𝄞the, " * 3000), (2, ""), (3, None), (4, "the")], "k int, s string")
    found = strings.locations(df, "k", "s", "the")
    assert found._jdf.queryExecution().executedPlan().toString().count("regexp_replace") == 1
    assert sorted((x.k, x.n, x.start, x.length) for x in found.collect()) == [(1, i, 7 * i + 2, 3) for i in range(3000)] + [(4, 0, 0, 3)]


@pytest.mark.parametrize("t", ["2024-12-30 23:30:00", "2021-01-01 00:00:00", "1969-12-31 23:59:59.999999", "2024-02-29 12:29:59"])
def test_times(spark, t):
    import datetime

    d = datetime.datetime.fromisoformat(t)
    c = F.lit(t).cast("timestamp")
    p = times.parts(c)
    r = one(spark, y=p["year"], w=p["week"], doy=p["dayofyear"], dow=p["dayofweek"], us=p["microsecond"], ms=p["millisecond"], iso=times.isocalendar(c), fl=times.micros(times.floor(c, "h")), leap=p["is_leap_year"])
    assert (r.y, r.w, r.doy, r.dow) == (d.year, d.isocalendar()[1], d.timetuple().tm_yday, d.weekday())
    assert (r.ms, r.us) == divmod(d.microsecond, 1000) and tuple(r.iso) == tuple(d.isocalendar())
    hour = d.replace(minute=0, second=0, microsecond=0, tzinfo=datetime.timezone.utc)
    assert r.fl == int(hour.timestamp()) * 1_000_000 and r.leap == (d.year == 2024)


def test_ragged(spark):
    df = spark.createDataFrame([(0, []), (1, [3, 3, 1, 1, 3]), (2, [7])], "id int, xs array<long>")
    r = df.select("id", ragged.remove_repeats("xs").alias("u"), ragged.repeat_counts("xs").alias("n"), ragged.get_jth("xs", 1, -1).alias("j"), ragged.get_ngrams("xs", 2).alias("g"), ragged.xor("xs").alias("x"), ragged.argmax("xs").alias("am"), ragged.get_prefixes("xs", 1).alias("p")).orderBy("id").collect()
    assert [x.u for x in r] == [[], [3, 1, 3], [7]] and [x.n for x in r] == [[], [2, 2, 1], [1]]
    assert [x.j for x in r] == [-1, 3, -1] and [len(x.g) for x in r] == [0, 4, 0] and [x.x for x in r] == [0, 3, 7] and [x.am for x in r] == [None, 0, 0] and [x.p for x in r] == [None, [3], None]
    back = ragged.gather(ragged.flatten(df, "id", "xs"), "id", "pos", "value")
    assert {x.id: x["values"] for x in back.collect()} == {1: [3, 3, 1, 1, 3], 2: [7]}
