"""Chains of snapshots and deltas in batch: validation, gaps, the receive protocol, succession, silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate(rows: DataFrame, by: str = "chain_id", order: str = "sequence", effective: str = "effective_at") -> DataFrame:
    """Each row with `error`: its sequence repeats the one before, or its effective time falls behind it."""
    w = Window.partitionBy(by).orderBy(order)
    same, back = F.lag(order).over(w) == F.col(order), F.col(effective) < F.lag(effective).over(w)
    return rows.withColumn("error", F.when(same, "sequence not increasing").when(back, "effective time before the predecessor's"))


def gaps(rows: DataFrame, by: str = "chain_id", order: str = "sequence") -> DataFrame:
    """One row per run of missing sequences between seen ones: by, gap_start, gap_end (inclusive)."""
    nxt = F.lead(order).over(Window.partitionBy(by).orderBy(order))
    return rows.select(by, order).distinct().withColumn("n", nxt).where(F.col("n") > F.col(order) + 1).select(by, (F.col(order) + 1).alias("gap_start"), (F.col("n") - 1).alias("gap_end"))


def quality(rows: DataFrame, by: str = "chain_id", order: str = "sequence") -> DataFrame:
    """Per chain: its gaps as sorted ranges."""
    return gaps(rows, by, order).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("gap_start").alias("start"), F.col("gap_end").alias("end")))).alias("gaps"))


def taint_metrics(rows: DataFrame, by: str = "chain_id", order: str = "sequence", at: str = "published_at", as_of: Column | None = None) -> DataFrame:
    """Per chain: frontier, taint size, age of the oldest gap in `at` units (as_of or the chain's last), density."""
    w = Window.partitionBy(by).orderBy(order)
    g = rows.select(by, order, at).withColumn("__d", F.col(order) - F.lag(order).over(w) - 1)
    total = F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0))
    seen, low = F.max(order), F.min(order)
    age = (F.max(at) if as_of is None else F.max(as_of)) - F.min(F.when(F.col("__d") > 0, F.col(at)))
    return g.groupBy(by).agg(seen.alias("frontier"), total.alias("taint_size"), age.alias("taint_age"), (total / F.greatest(seen - low, F.lit(1))).alias("taint_density"))


def receive(rows: DataFrame, by: str, order: str, arrival: list[str], recovery: Column | None = None, closed: Column | None = None) -> DataFrame:
    """The receive protocol with strong rejection, in batch: each row with `frontier` before it and `verdict`.

    applied, gap (applied past a gap), duplicate, late (tainted, discarded), anchor (a recovery snapshot: the frontier
    moves to it and taint is empty), terminator (`closed` and accepted), rejected (after an accepted terminator or a closed
    anchor; a terminator that is late or a duplicate ends nothing). Chains start at frontier 0. The same as the stream's.
    """
    w = Window.partitionBy(by).orderBy(*arrival)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    d = rows.withColumns({"__anchor": flag(recovery), "__closes": flag(closed)})
    d = d.withColumn("__part", F.sum(F.col("__anchor").cast("int")).over(so_far))
    part = Window.partitionBy(by, "__part").orderBy(*arrival)
    whole = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"__after": F.max(order).over(part.rowsBetween(Window.unboundedPreceding, 0)), "__floor": F.coalesce(F.max(F.when(F.col("__anchor"), F.col(order))).over(whole), F.lit(0))})
    d = d.withColumn("__after", F.greatest("__after", F.lit(0)))
    d = d.withColumn("frontier", F.coalesce(F.lag("__after").over(w), F.lit(0)))
    d = d.withColumn("__ok", F.col("__anchor") | (F.col(order) > F.col("frontier")))
    d = d.withColumn("__end", F.first(F.when(F.col("__ok") & F.col("__closes"), F.col(order)), True).over(before))
    same = Window.partitionBy(by, "__part", order).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("__ok").cast("int")).over(same), F.lit(0)) == 1
    verdict = (
        F.when(F.col("__end").isNotNull(), "rejected").when(F.col("__anchor"), "anchor").when(F.col("__ok") & F.col("__closes"), "terminator").when(F.col("__ok") & (F.col(order) == F.col("frontier") + 1), "applied")
        .when(F.col("__ok"), "gap").when(seen | (F.col(order) <= F.col("__floor")), "duplicate").otherwise("late")
    )
    d = d.withColumns({"verdict": verdict, "frontier": F.coalesce("__end", "frontier")})
    return d.drop("__anchor", "__closes", "__part", "__after", "__floor", "__ok", "__end")


def carry_forward(rows: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """`column` where it is null has the last value before it on its chain."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, True).over(w))


def succession(chains: DataFrame) -> DataFrame:
    """Each chain with its successor: chain_id, next_chain_id, and whether the successor names it as predecessor."""
    nxt = chains.select(F.col("chain_id").alias("next_chain_id"), F.col("previous_chain_id").alias("__p"))
    return chains.where(F.col("next_chain_id").isNotNull()).join(nxt, "next_chain_id", "left").select("chain_id", "next_chain_id", F.col("__p").eqNullSafe(F.col("chain_id")).alias("mutual"))


def silence_as_close(rows: DataFrame, by: str, at: str, order: list[str], silence: int) -> DataFrame:
    """Sessions that a silence of at least `silence` (in units of `at`) ends: by, session, opened, closed, n."""
    w = Window.partitionBy(by).orderBy(at, *order)
    new = F.when(F.col(at) - F.lag(at).over(w) >= silence, 1).otherwise(0)
    s = rows.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(by, "session").agg(F.min(at).alias("opened"), F.max(at).alias("last_seen"), F.count("*").alias("n")).withColumn("closed_at", F.col("last_seen") + silence)


def dispose(rows: DataFrame, chain_ids: DataFrame) -> DataFrame:
    """rows without those of disposed chains."""
    return rows.join(chain_ids.select("chain_id").distinct(), "chain_id", "left_anti")


def cadence_points(rows: DataFrame, by: str, order: str, at: str, floor: int, changes: int) -> DataFrame:
    """Rows at which a snapshot is due: the first of a time slot of `floor`, or every `changes`-th."""
    w = Window.partitionBy(by).orderBy(order)
    slot = F.floor(F.col(at) / floor)
    due = (F.coalesce(F.lag(slot).over(w), slot - 1) != slot) | ((F.row_number().over(w) - 1) % changes == 0)
    return rows.withColumn("due", due)
