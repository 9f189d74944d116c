"""Relation sets: keyed, sorted, time-bounded adjacency, folded from assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["sid", "st", "si", "dt"]
RELATION = "array<struct<di:string,ttl:bigint,exp:bigint>>"
#: A shorter life of a key than a second is raised to this.
SHORT_MS, RAISED_MS = 1000, 2000


def at_ms(assertions: DataFrame) -> Column:
    """The assertion's time: its own column, or what its expiry and ttl say (which quantised ones round)."""
    return F.col("at_ms") if "at_ms" in assertions.columns else F.col("exp") - F.col("ttl")


def key_ttl_ms(ttl_ms: int) -> int:
    """How long a key lives that is created with this ttl."""
    return RAISED_MS if 0 < ttl_ms < SHORT_MS else ttl_ms


def key_lives(assertions: DataFrame, order: list[str]) -> DataFrame:
    """Per key: the assertion that created it first, and when the key goes that it created: KEY, created_ms, dies_ms."""
    made = assertions.where("ttl > 0").withColumn("__at", at_ms(assertions))
    first = made.groupBy(*KEY).agg(F.min_by(F.struct("__at", "ttl"), F.struct(*order)).alias("a"))
    life = F.when(F.col("a.ttl") < SHORT_MS, RAISED_MS).otherwise(F.col("a.ttl"))
    return first.select(*KEY, F.col("a.__at").alias("created_ms"), (F.col("a.__at") + life).alias("dies_ms"))


def edges(assertions: DataFrame, order: list[str], phantom: bool = False) -> DataFrame:
    """One row per relation that stands: KEY, di, ttl, exp. `order` breaks all ties among a key's assertions.

    The last assertion on a relation decides; a ttl of 0 or less retracts. With `phantom`, a retraction that is its
    key's very first assertion leaves a relation of ttl 0, as the compatible mode has it.
    """
    at = F.struct(*order)
    last = assertions.groupBy(*KEY, "di").agg(F.max_by(F.struct("ttl", "exp"), at).alias("a"), F.max(at).alias("o"))
    if not phantom:
        return last.where(F.col("a.ttl") > 0).select(*KEY, "di", "a.ttl", "a.exp")
    first = assertions.groupBy(*KEY).agg(F.min(at).alias("f"))
    return last.join(first, KEY).where((F.col("a.ttl") > 0) | (F.col("o") == F.col("f"))).select(*KEY, "di", F.greatest("a.ttl", F.lit(0)).alias("ttl"), "a.exp")


def relation_sets(assertions: DataFrame, order: list[str], phantom: bool = False) -> DataFrame:
    """One row per key that was ever asserted: KEY, ts (time of its last assertion), r sorted by di in byte order.

    Two map-side-combined aggregations: relations first, keys then. A set whose relations are all retracted is empty.
    """
    at = F.struct(*order)
    rel = assertions.withColumn("__ts", at_ms(assertions)).groupBy(*KEY, "di").agg(
        F.max_by(F.struct("ttl", "exp", "__ts"), at).alias("a"), F.max(at).alias("o"), F.min(at).alias("f"), F.max("ttl").alias("most")
    )
    if phantom:
        w = F.min("f").over(Window.partitionBy(*KEY))
        rel = rel.withColumn("stands", (F.col("a.ttl") > 0) | (F.col("o") == w))
    else:
        rel = rel.withColumn("stands", F.col("a.ttl") > 0)
    r = F.array_sort(F.collect_list(F.when(F.col("stands"), F.struct("di", F.greatest("a.ttl", F.lit(0)).alias("ttl"), F.col("a.exp").alias("exp"))))).cast(RELATION)
    sets = rel.groupBy(*KEY).agg(F.max_by(F.col("a.__ts"), "o").alias("ts"), r.alias("r"), F.max("most").alias("most"))
    return (sets if phantom else sets.where("most > 0")).select(*KEY, "ts", "r")


def edges_of(sets: DataFrame) -> DataFrame:
    """The normal form: one row per relation."""
    return sets.select(*KEY, F.explode("r").alias("x")).select(*KEY, "x.*")


def apply_assertions(sets: DataFrame, assertions: DataFrame, order: list[str]) -> DataFrame:
    """Standing sets and newer assertions to sets; equals folding all assertions at once."""
    numbers = [F.lit(None).cast(assertions.schema[c].dataType).alias(c) for c in order]
    old = sets.select(*KEY, "ts", F.explode_outer("r").alias("x"))
    as_rows = old.select(*KEY, F.coalesce("x.di", F.lit("")).alias("di"), F.coalesce("x.ttl", F.lit(0)).alias("ttl"), F.coalesce("x.exp", "ts").alias("exp"), *numbers, F.lit(0).alias("__new"), F.col("ts").alias("__ts"))
    new = assertions.select(*KEY, "di", "ttl", "exp", *order, F.lit(1).alias("__new"), at_ms(assertions).alias("__ts"))
    at = F.struct("__new", *order)
    rel = as_rows.unionByName(new).groupBy(*KEY, "di").agg(F.max_by(F.struct("ttl", "exp", "__ts"), at).alias("a"), F.max(at).alias("o"), F.max("ttl").alias("most"), F.min("__new").alias("n"))
    r = F.array_sort(F.collect_list(F.when(F.col("a.ttl") > 0, F.struct("di", "a.ttl", "a.exp")))).cast(RELATION)
    done = rel.groupBy(*KEY).agg(F.max_by(F.col("a.__ts"), "o").alias("ts"), r.alias("r"), F.max("most").alias("most"), F.min("n").alias("n"))
    return done.where("most > 0 or n = 0").select(*KEY, "ts", "r")


def live(rows: DataFrame, as_of_ms: Column) -> DataFrame:
    """Relations that haven't expired; for sets, each without its expired relations."""
    if "r" in rows.columns:
        return rows.withColumn("r", F.filter("r", lambda x: x["exp"] > as_of_ms))
    return rows.where(F.col("exp") > as_of_ms)


def expiries(rows: DataFrame, as_of_ms: Column) -> DataFrame:
    """Retractions for relations that have expired."""
    return rows.where(F.col("exp") <= as_of_ms).select(*KEY, "di", F.lit(0).cast("long").alias("ttl"), "exp")


def reverse_edges(rows: DataFrame) -> DataFrame:
    """Relations from the destination's side, one row each: as many rows as relations, whatever a destination's size."""
    return rows.select("sid", "dt", "di", "st", "si").distinct()


def reverse(rows: DataFrame) -> DataFrame:
    """Per destination: the sources that relate to it, in one row. For destinations of any size there is reverse_edges()."""
    return rows.groupBy("sid", "dt", "di", "st").agg(F.array_sort(F.collect_set("si")).alias("sources"))


def constrain(rows: DataFrame, forward: bool = True, backward: bool = True, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """At most one relation a source and a destination: (kept, retractions of the older ones).

    The newest relation of each side (of equal ones, that of the greatest source and destination) is a map-side-combined
    aggregate, and rows meet it by all that tells a relation, so a destination with any number of relations isn't in one task.
    """
    by = order or ["exp"]
    whole = [*KEY, "di", *by]
    marked, held = rows, F.lit(True)
    for name, side in (("__f", ["sid", "st", "si", "dt"]),) * forward + (("__b", ["sid", "dt", "di", "st"]),) * backward:
        newest = rows.groupBy(*side).agg(F.max(F.struct(*by, "si", "di")).alias("w"))
        newest = newest.select(*(F.col(c) if c in side else F.col(f"w.{c}").alias(c) for c in whole), F.lit(True).alias(name))
        marked, held = marked.join(newest, whole, "left"), held & F.col(name).isNotNull()
    out = marked.select(*rows.columns, held.alias("__held"))
    return out.where("__held").drop("__held"), out.where("not __held").drop("__held").withColumn("ttl", F.lit(0).cast("long"))


def unknown_retractions(assertions: DataFrame, sets: DataFrame) -> DataFrame:
    """Retractions whose key no set has."""
    return assertions.where("ttl <= 0").join(sets.select(*KEY), KEY, "left_anti")
