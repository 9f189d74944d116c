"""What plans must not do, as it costs more than in proportion."""

from collections import Counter

from pyspark.sql import functions as F

from twinloom.operators import tabulate
from twinloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_sketches_are_kept_once_and_not_for_each_distinct_value(spark):
    plan = QUERIES["approximate_aggregates"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if "Aggregate(" in line and "percentile_approx" in line]
    assert kept and all("keys=[]" in line for line in kept)


def test_pairs_of_a_set_that_many_keys_have_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(tabulate, "BLOCK", 8, raising=False)
    sets = {**{f"k{i}": "abc" for i in range(60)}, **{f"l{i}": "ab" for i in range(5)}, None: "c"}
    df = spark.createDataFrame([(k, list(m)) for k, m in sets.items()], "k string, members array<string>")
    got = tabulate.superset_pairs(df, df, "k", "members").withColumn("part", F.spark_partition_id()).collect()
    assert Counter((r.a_key, r.b_key) for r in got) == Counter((x, y) for x, m in sets.items() for y, n in sets.items() if set(n) <= set(m))
    assert max(Counter(r.part for r in got).values()) < len(got) / 4
