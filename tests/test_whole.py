"""Queries over whole tables reach every row, whatever the size."""

from tessella.plans import core
from tessella.session import table


def run(spark, sf_dir, name):
    return core.queries()[name](spark, sf_dir).collect()


def column(spark, sf_dir, name, key):
    return [r[0] for r in table(spark, sf_dir, name).select(key).collect()]


def test_sets_of_whole_columns(spark, sf_dir):
    a, b = set(column(spark, sf_dir, "orders", "o_totalprice")), set(column(spark, sf_dir, "lineitem", "l_extendedprice"))
    for name, want in (("union", a | b), ("intersect", a & b), ("diff", b - a), ("xor", a ^ b)):
        got = [r.v for r in run(spark, sf_dir, f"q_set_{name}_whole")]
        assert want and len(got) == len(want) and set(got) == want


def test_merges_of_whole_tables(spark, sf_dir):
    a, b = set(column(spark, sf_dir, "events", "event_id")), set(column(spark, sf_dir, "lineitem", "l_orderkey"))
    assert a & b and a - b and b - a
    for how, want in (("inner", a & b), ("left", a), ("right", b), ("outer", a | b)):
        assert {r.key for r in run(spark, sf_dir, f"q_merge_{how}_whole")} == want


def test_product_of_whole_matrices(spark, sf_dir):
    width = len(column(spark, sf_dir, "embeddings", "embedding")[0])
    got = [(r.i, r.j) for r in run(spark, sf_dir, "q_matmul_tril_whole")]
    assert sorted(got) == [(i, j) for i in range(width) for j in range(i + 1)]


def test_gather_and_lookup_reach_every_row(spark, sf_dir):
    orders = column(spark, sf_dir, "orders", "o_orderkey")
    got = run(spark, sf_dir, "q_gather_whole")
    assert sorted(r["index"] for r in got) == list(range(len(orders))) and {r.o_orderkey for r in got} == set(orders)
    found = {r.doc_id: r.quality for r in run(spark, sf_dir, "q_lookup_whole")}
    labels = set(column(spark, sf_dir, "labels", "doc_id"))
    assert set(found) == set(column(spark, sf_dir, "documents", "doc_id")) and {k for k, v in found.items() if v >= 0} == labels != set(found)
