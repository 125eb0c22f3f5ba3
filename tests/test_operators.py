import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import categorical, create, frame, groupby, joins, linalg, position, random, sets, stats
from tessella.sources import io


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_position_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert rows(position.with_position(df, ["v"])) == [(i, i) for i in range(1000)]


def test_running_and_shift(spark):
    df = spark.range(100)
    assert [r.s for r in position.running(df, ["id"], F.col("id"), "s").orderBy("id").collect()] == list(np.cumsum(range(100)))
    assert [r.s for r in position.shift(df, ["id"], "id", 2, "s", wrap=True).orderBy("id").collect()] == list(np.roll(range(100), 2))


@pytest.mark.parametrize("side", ["left", "right"])
def test_searchsorted(spark, side):
    xs, vs = sorted([1, 1, 2, 5, 5, 9]), [0, 1, 3, 5, 10]
    df, v = spark.createDataFrame([(x,) for x in xs], "x long"), spark.createDataFrame([(x,) for x in vs], "v long")
    got = {r.v: r.slot for r in position.searchsorted(df, v, "x", "v", side).collect()}
    assert got == dict(zip(vs, np.searchsorted(xs, vs, side).tolist(), strict=True))


def test_reductions_with_nan_groups(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 0, nan), (1, 1, nan), (2, 2, nan), (2, 3, 4.0), (2, 4, 1.0), (3, 5, 2.0), (None, 6, 9.0)], "k int, pos int, v double")
    asked = {"n": ("count", "v"), "s": ("sum", "v"), "f": ("first", "v"), "am": ("argmin", "v"), "sd": ("var", "v")}
    got = {r.k: r for r in groupby.aggregate(df, ["k"], asked, ["pos"]).collect()}
    assert set(got) == {1, 2, 3} and [got[k].n for k in (1, 2, 3)] == [0, 2, 1]
    assert got[2].s == 5 and got[2].f == 4 and got[2].am.pos == 4 and got[2].sd == 4.5 and np.isnan(got[3].sd)


def test_mode_takes_least_of_ties(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 3), (1, 3), (2, 9)], "k int, v int")
    assert rows(groupby.mode(df, ["k"], "v")) == [(1, 3), (2, 9)]


def test_merge_against_pandas(spark):
    import pandas as pd

    a = pd.DataFrame({"k": [1, 2, 2, 4], "v": [1, 2, 3, 4]})
    b = pd.DataFrame({"k": [2, 4, 5], "v": [7, 8, 9]})
    for how in ("inner", "left", "right", "outer"):
        got = joins.merge(spark.createDataFrame(a), spark.createDataFrame(b), on="k", how=how).toPandas()
        want = a.merge(b, on="k", how=how)
        norm = lambda x: sorted(tuple(-1.0 if pd.isna(y) else float(y) for y in r) for r in x.itertuples(index=False))
        assert list(got.columns) == list(want.columns) and norm(got) == norm(want), how


def test_dt_join_is_brute_force(spark):
    rng = np.random.default_rng(0)
    a = [(int(i), int(rng.integers(3)), int(rng.integers(100))) for i in range(60)]
    b = [(int(i), int(rng.integers(3)), int(rng.integers(100))) for i in range(60)]
    da, db = spark.createDataFrame(a, "id int, k int, t int"), spark.createDataFrame(b, "id int, k int, t int")
    for kind, test in (("abs_dt", lambda g: abs(g) <= 7), ("pos_dt", lambda g: 0 <= g <= 7), ("true_dt", lambda g: True)):
        got = joins.join_on_eq_with_dt(da, db, "k", "t", "t", 7, kind).select("left_id", "right_id")
        assert rows(got) == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and test(y[2] - x[2]))


def test_intervals_closed_with_tiebreak(spark):
    iv = spark.createDataFrame([(0, 10, 2), (5, 15, 1), (15, 20, 3)], "low int, high int, rank int")
    v = spark.createDataFrame([(0,), (5,), (10,), (15,), (20,), (21,)], "x int")
    got = {r.x: r.interval and r.interval.i_rank for r in joins.search_intervals(v, iv, "x", tiebreak="rank").collect()}
    assert got == {0: 2, 5: 1, 10: 1, 15: 1, 20: 3, 21: None}


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "v int") for xs in ([-1, 0, 1, 3, 3], [-1, 2, 2, 3]))
    f = lambda df: [r.v for r in df.orderBy("v").collect()]
    assert f(sets.union(a, b)) == [-1, 0, 1, 2, 3] and f(sets.intersect(a, b)) == [-1, 3] and f(sets.setdiff(a, b)) == [0, 1] and f(sets.setxor(a, b)) == [0, 1, 2]


@pytest.mark.parametrize("method", stats.METHODS)
def test_quantiles_like_numpy(spark, method):
    xs = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    qs = [0.0, 0.1, 0.35, 0.5, 0.8, 1.0]
    got = {r.q: r.value for r in stats.quantiles(df, "x", qs, method).collect()}
    for q in qs:
        assert got[q] == pytest.approx(float(np.quantile(xs, q, method=method))), (method, q)


def test_quantiles_of_all_methods_sort_once(spark, monkeypatch):
    """All definitions share one running count; repeats, nulls and NaN among the values."""
    xs = [3.0, 1.0, 3.0, None, 1.5, 9.0, float("nan"), 2.6, 3.0]
    sorts, plain = [], position.running
    monkeypatch.setattr(position, "running", lambda *a, **k: sorts.append(a) or plain(*a, **k))
    qs, kept = [0.0, 0.1, 0.35, 0.5, 0.8, 1.0], [x for x in xs if x is not None and x == x]
    rows = stats.quantiles_by_methods(spark.createDataFrame([(x,) for x in xs], "x double"), "x", qs, stats.METHODS).collect()
    assert len(sorts) == 1 and len(rows) == len(qs) * len(stats.METHODS)
    for r in rows:
        assert r.value == pytest.approx(float(np.quantile(kept, r.q, method=r.method))), (r.method, r.q)
    assert stats.quantiles_by_methods(spark.createDataFrame([(None,)], "x double"), "x", qs, stats.METHODS).collect() == []


def test_histogram_like_numpy(spark):
    xs = np.random.default_rng(1).normal(size=500)
    want, _ = np.histogram(xs, 9)
    got = {r.bin_0: r.n for r in stats.histogram(spark.createDataFrame([(float(x),) for x in xs], "x double"), "x", bins=9).collect()}
    assert [got.get(i, 0) for i in range(9)] == want.tolist()


def test_chisquare_pvalue():
    assert stats.chisquare_pvalue(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chisquare_pvalue(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)


def test_matrices(spark):
    a, b = np.array([[1.0, 2], [0, 3]]), np.array([[4.0, 0], [5, 6]])
    long = lambda x: spark.createDataFrame([(i, j, float(x[i, j])) for i in range(2) for j in range(2) if x[i, j]], "i long, j long, v double")
    out = np.zeros((2, 2))
    for r in linalg.matmul(long(a), long(b)).collect():
        out[r.i, r.j] = r.v
    assert (out == a @ b).all()
    assert rows(linalg.csr(long(a)).select("i", "start")) == [(0, 0), (1, 2)]
    assert rows(linalg.tril(linalg.add(linalg.eye(spark, 2), long(a)))) == [(0, 0, 2.0), (1, 1, 4.0)]


def test_random_does_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "pos")
    draw = lambda d: rows(d.select("pos", random.Generator(5).standard_gamma(2.0).alias("g")))
    assert draw(df.repartition(3)) == draw(df.coalesce(1))
    g = random.Generator(1)
    r = df.agg(F.avg(g.normal()), F.avg(g.poisson(3.0)), F.avg(g.standard_gamma(2.0)), F.avg(g.exponential(2.0))).first()
    assert abs(r[0]) < 0.1 and abs(r[1] - 3) < 0.2 and abs(r[2] - 2) < 0.2 and abs(r[3] - 2) < 0.2


def test_random_of_large_rates_and_small_shapes(spark):
    df, g = spark.range(4000).withColumnRenamed("id", "pos"), random.Generator(2)
    for lam in (150.0, 2000.0, 1e7):
        mean, var = df.select(g.poisson(lam).alias("x")).agg(F.avg("x"), F.var_samp("x")).first()
        assert abs(mean - lam) < 5 * (lam / 4000) ** 0.5 and 0.85 < var / lam < 1.15
    mean, var = df.select(g.standard_gamma(0.5).alias("x")).agg(F.avg("x"), F.var_samp("x")).first()
    assert abs(mean - 0.5) < 0.06 and abs(var - 0.5) < 0.15


def test_random_sparse_has_its_density(spark):
    m = linalg.random_sparse(spark, 50, 0.2, 3)
    assert m.count() == 500 == m.select("i", "j").distinct().count()
    assert rows(m) == rows(linalg.random_sparse(spark, 50, 0.2, 3).repartition(3))


def test_time_join_with_a_limit(spark):
    df = spark.createDataFrame([(i, 1, i) for i in range(20)], "id int, k int, t int")
    assert joins.join_on_eq_with_dt(df, df, "k", "t", "t", 2, limit=7).count() == 7


def test_reductions_by_value_on_a_hot_group(spark):
    data = [(None if i % 50 == 0 else "hot" if i % 3 else "b", None if i % 7 == 0 else float(i % 5)) for i in range(700)]
    df = spark.createDataFrame(data, "k string, v double")
    got = groupby.aggregate(df, ["k"], {"m": ("median", "v"), "n": ("nunique", "v"), "u": ("unique", "v"), "o": ("mode", "v"), "s": ("sum", "v")}, dropna=False)
    assert got.columns == ["k", "m", "n", "u", "o", "s"]
    for r in got.collect():
        xs = [v for k, v in data if k == r.k and v is not None]
        assert (r.m, r.n, r.u, r.s) == (float(np.median(xs)), len(set(xs)), sorted(set(xs)), sum(xs))
        assert r.o == min(set(xs), key=lambda x: (-xs.count(x), x))


def test_construction(spark):
    f = lambda df: [r.value for r in df.orderBy("pos").collect()]
    a = create.arange(spark, 2, 11, 3)
    assert f(a) == [2, 5, 8] and f(create.flip(a)) == [8, 5, 2] and f(create.tile(a, 2)) == [2, 5, 8, 2, 5, 8] and f(create.delete(a, [1])) == [2, 8]
    assert f(create.linspace(spark, 0, 1, 5)) == [0, 0.25, 0.5, 0.75, 1] and create.broadcast_shapes((3, 1), (4,)) == (3, 4)


def test_categorical(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, c string")
    cat = categorical.Categorical.of(df, "c")
    assert rows(cat.data.select("id", "code")) == [(1, 1), (2, 0), (3, -1), (4, 1)]
    assert {r.id: r.c for r in cat.set_categories(["b"]).to_strings().collect()} == {1: "b", 2: None, 3: None, 4: "b"}


def test_frame(spark):
    f = frame.Frame.of(spark.createDataFrame([(3, "x", 1.0), (1, "y", float("nan")), (2, "x", 5.0)], "o int, k string, v double"), ["o"])
    assert len(f) == 3 and f[0:2].df.count() == 2 and f.dropna().df.count() == 2 and f.fillna(0.0)["v"].sum() == 6
    assert rows(f.groupby("k").sum("v")) == [("x", 6.0), ("y", None)] and f["v"].argmax() == 1
    assert f.append(f).df.agg(F.max("index")).first()[0] == 5


def test_series_accessors(spark):
    f = frame.Frame.of(spark.createDataFrame([(1, "ab"), (2, "Cd")], "o int, s string"), ["o"])
    s = f["s"]
    assert [r.value for r in s.str.upper().sort_index().collect()] == ["AB", "CD"] and [r.value for r in s.iloc(1, 2).df.collect()] == ["Cd"]
    assert [r.value for r in s.map({"ab": 1}).sort_index().collect()] == [1, None] and s.head(1).df.count() == 1


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "i long, s string, v double")
    for kind in ("parquet", "orc", "json"):
        io.write(df, str(tmp_path / kind), kind, compression=None)
        assert io.read(spark, str(tmp_path / kind), kind, schema=df.schema).count() == 2
    io.to_csv(df, str(tmp_path / "csv"))
    assert io.read_csv(spark, str(tmp_path / "csv"), "i long, s string, v double", columns=["i"]).count() == 2
    io.snapshot(spark, str(tmp_path / "snap"), a=df)
    assert io.restore(spark, str(tmp_path / "snap"), "a")["a"].count() == 2 and io.null_counts(df).first().s == 1
    with pytest.raises(MemoryError):
        io.to_pandas(df, 1)


def test_streaming_windows(spark, sf_dir, tmp_path):
    from tessella.streaming import windows

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for kind in ("timestamp", "timestamp_ntz"):
        assert windows.windowed(events.withColumn("ts", F.col("ts").cast(kind)), "ts", ["event_type"], "value", "1 hour").agg(F.sum("n")).first()[0] == events.count()
        assert windows.sessions(events.withColumn("ts", F.col("ts").cast(kind)), "ts", ["user_id"]).agg(F.sum("n")).first()[0] == events.count()
    schema = events.schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").symlink_to(f"{sf_dir}/events.parquet")
    stream = windows.read_stream(spark, str(tmp_path / "in"), schema)
    out = windows.windowed(stream, "ts", ["event_type"], "value", "1 hour")
    windows.run_to_end(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    done = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    batch = windows.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], "value", "1 hour")
    assert 0 < done.count() <= batch.count() and set(map(tuple, done.select("start", "event_type", "n").collect())) <= set(map(tuple, batch.select("start", "event_type", "n").collect()))
