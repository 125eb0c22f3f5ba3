"""Every registered query of the engine runs, and agrees with its SQL twin."""

import datetime
import math

import pytest

from tessella.plans import core

ORACLE = core.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(core.queries()))
def test_query(spark, sf_dir, duck, name):
    df = core.queries()[name](spark, sf_dir)
    got = df.collect()
    if name in ORACLE:
        want = duck.execute(ORACLE[name])
        names = [x[0] for x in want.description]
        assert sorted(df.columns) == sorted(names)
        assert table(df.columns, got) == table(names, want.fetchall())
    else:
        assert got


def test_entry_point_imports(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
