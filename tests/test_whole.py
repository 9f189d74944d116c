"""Rows that the given tables lack: joins without a match, sets of every size."""

from twinloom.operators import tabulate
from twinloom.plans.catalogue import QUERIES


def test_zero_defaults_without_orders(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(7, 1, 2.5, "F")], "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in QUERIES["zero_defaults"](spark, str(tmp_path)).select("c_custkey", "o_orderkey", "o_totalprice", "o_orderstatus", "absent").collect()}
    assert got == {(1, 7, 2.5, "F", 0), (2, None, 0.0, "", 0)}


def test_full_outer_unmatched(spark, tmp_path):
    spark.createDataFrame([(3,), (3,), (4,)], "c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3,), (6,)], "s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {tuple(r) for r in QUERIES["full_outer"](spark, str(tmp_path)).select("k", "customers", "suppliers").collect()} == {(3, 2, 1), (4, 1, None), (6, None, 1)}


def test_superset_pairs_of_small_sets(spark):
    sets = {"p": "", "q": "a", "r": "ab", "s": "ba", "t": "abc", "u": "d", "v": "abcd"}
    df = spark.createDataFrame([(k, list(m)) for k, m in sets.items()], "k string, members array<string>")
    got = [tuple(r) for r in tabulate.superset_pairs(df, df.where("size(members) > 0"), "k", "members").collect()]
    assert sorted(got) == sorted((x, y) for x, m in sets.items() for y, n in sets.items() if n and set(n) <= set(m))
