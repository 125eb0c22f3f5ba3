import pytest
from pyspark.sql import functions as F
from tessella.functions import strings, times
from tessella.operators import frame, labels, stats


@pytest.fixture(scope="module")
def ints(spark):
    return labels.Index.of(spark.createDataFrame([(i, v) for i, v in enumerate([3, 1, None, 2, 1])], "o int, k int"), "k", ["o"])


def test_index_items_and_order(ints):
    assert ints.tolist() == [3, 1, None, 2, 1] and len(ints) == 5 and ints.shape == (5,) and ints.nlevels == ints.ndim == 1
    assert ints[0] == 3 and ints[-1] == 1 and ints[1:4].tolist() == [1, None, 2] and ints[::2].tolist() == [3, None, 1]
    assert ints[[4, 0, 0]].tolist() == [1, 3, 3] and ints[F.col("k") > 1].tolist() == [3, 2]
    done, order = ints.sort_values(return_indexer=True)
    assert done.tolist() == [1, 1, 2, 3, None] and [r.pos for r in order.orderBy("rank").collect()] == [1, 4, 3, 0, 2]
    assert ints.sort_values(ascending=False, na_position="first").tolist() == [None, 3, 2, 1, 1]
    with pytest.raises(IndexError):
        ints[9]


def test_index_equality_and_sets(spark, ints):
    assert ints.equals(ints) is False  # a missing label equals nothing
    whole = ints[F.col("k").isNotNull()]
    assert whole.equals(whole) and not whole.equals(whole[1:]) and not whole.is_unique() and whole[0:2].is_unique()
    assert whole.concat(whole[:1]).tolist() == [3, 1, 2, 1, 3] and whole.set_dtype("string").tolist() == ["3", "1", "2", "1"]
    assert whole.map(spark.createDataFrame([(1, "x"), (3, "y")], "key int, value string")).tolist() == ["y", "x", None, "x"]
    assert [r.isin for r in ints.lookup(spark.createDataFrame([(1,), (1,)], "k int")).orderBy("pos").collect()] == [False, True, False, False, True]
    assert [r.eq for r in whole.eq(whole[:2]).orderBy("pos").collect()] == [True, True, False, False]
    assert whole.to_dict() == {"k": [3, 1, 2, 1]}


def test_multiindex(spark):
    df = spark.createDataFrame([(0, "b", 1), (1, "a", 2), (2, "a", 1)], "o int, x string, y int")
    m = labels.index(df, ["x", "y"], ["o"])
    assert isinstance(m, labels.MultiIndex) and m.nlevels == 2 and m.is_unique() and m[1] == ("a", 2)
    assert m.sort_values().tolist() == [("a", 1), ("a", 2), ("b", 1)] and m.get_level_values("y").tolist() == [1, 2, 1]
    assert labels.MultiIndex.from_levels(m.get_level_values(0), m.get_level_values(1)).equal_levels(m)


def test_series_places(spark):
    s = frame.Series(spark.createDataFrame([(10, 1.0), (20, 2.0), (20, 4.0), (30, None)], "index int, value double"))
    assert s.shape == (4,) and s.dtype == "double" and s.hasnans() and s.at(10) == 1.0 and s.at(20) == [2.0, 4.0] and s.iat(0) == 1.0 and s.iat(-1) is None
    assert sorted(r["index"] for r in s.loc([20, 30]).df.collect()) == [20, 20, 30]
    assert sorted((r["index"], r.value) for r in s.set_loc([30, 10], 9.0).df.collect()) == [(10, 9.0), (20, 2.0), (20, 4.0), (30, 9.0)]
    assert sorted(r.value or 0 for r in s.set_iloc(1, 3, 7.0).df.collect()) == [0, 1.0, 7.0, 7.0]
    with pytest.raises(KeyError):
        s.at(99)


def test_differences_by_name(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 4), ("b", 1, 1)], "k string, o int, v int")
    d = frame.Groups(df, ["k"], ["o"]).diffs("v")
    assert sorted((r.k, r.v) for r in d.sum().collect() if r.k == "a") == [("a", -1)] and {r.k: r.v for r in d.xor().collect()}["a"] == 2 ^ -3
    assert {r.k: r.v for r in d.count().collect()} == {"a": 2, "b": 0}


@pytest.mark.parametrize("method", ["linear", "lower", "higher", "midpoint", "nearest", "hazen", "weibull", "median_unbiased"])
def test_grouped_quantiles_like_numpy(spark, method):
    import numpy as np

    rng = np.random.default_rng(5)
    data = [(int(k), float(v)) for k, v in zip(rng.integers(0, 4, 90), rng.integers(0, 12, 90), strict=True)] + [(9, 2.5)]
    got = {(r.k, r.q): r.value for r in stats.grouped_quantiles(spark.createDataFrame(data, "k int, v double"), ["k"], "v", [0.0, 0.15, 0.5, 0.99, 1.0], method).collect()}
    for (k, q), value in got.items():
        assert value == pytest.approx(float(np.quantile([v for j, v in data if j == k], q, method=method))), (k, q)
    assert len(got) == 25


def test_sub_count_and_matches(spark):
    r = spark.range(1).select(
        strings.sub(F.lit("a1b22c3"), "([0-9])", "<$1>", 2).alias("a"), strings.sub(F.lit("xyz"), "q", "-", 1).alias("b"), strings.subn(F.lit("a1b2"), "[0-9]", "#", 1).alias("c"),
        strings.find_match(F.lit("ab12"), "[0-9]+").alias("d"), strings.find_match(F.lit("ab12"), "[0-9]+", "match").alias("e"), strings.find_match(F.lit("abab"), r"(ab)\1", "fullmatch").alias("f"),
    ).first()
    assert r.a == "a<1>b<2>2c3" and r.b == "xyz" and tuple(r.c) == ("a#b2", 1) and tuple(r.d) == (2, 4, "12") and r.e is None and tuple(r.f) == (0, 4, "abab")


def test_date_ranges_like_pandas(spark):
    import pandas as pd

    for kw in ({"start": "2024-01-01", "end": "2024-01-03", "inclusive": "left"}, {"end": "2024-01-03 05:00", "periods": 3, "normalize": True}, {"start": "2024-01-01", "end": "2024-01-02", "inclusive": "neither"}, {"start": "2024-01-05", "end": "2024-01-01"}):
        got = [r.t for r in times.date_range(spark, **kw, freq="d").orderBy("pos").collect()]
        assert got == [t.to_pydatetime() for t in pd.date_range(**kw, freq="D")], kw
    got = times.date_range(spark, "2024-01-01", 2, "h", tz="Asia/Tokyo").orderBy("pos").select(F.unix_micros("t")).collect()
    assert [r[0] for r in got] == [t.value // 1000 for t in pd.date_range("2024-01-01", periods=2, freq="h", tz="Asia/Tokyo")]
