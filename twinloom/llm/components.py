"""Connected components of a link table, distributed: alternating large-star and small-star steps.

Every step is a map-side-combined minimum and an equi-join; no component is ever gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v and the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.select("u", F.least("u", "m").alias("m")), "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row per node of at least one link: node, root (the least node that is reachable).

    Links without an end or with two equal ones are left out; no links give no rows. Steps go on until nothing changes.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = C.checkpoint(edges)
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _with_least(large)  # all v < u here
        small = least.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = C.checkpoint(small)
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
