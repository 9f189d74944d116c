"""Transformations of message streams in batch: downsampling, synthesis, comparison with the predecessor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slots(at: Column, width: int, slide: int | None = None) -> Column:
    """Start of the slot of `at` (whole numbers), or an array of all sliding slots that hold it."""
    if slide is None:
        return (F.floor(at / F.lit(width)) * width).cast("long")
    first = (F.floor(at / F.lit(slide)) * slide).cast("long")
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit((width - 1) // slide)), lambda i: first - i * slide), lambda s: s > at - width)


def aggregate(rows: DataFrame, by: list[str], at: str, width: int, values: list[Column], slide: int | None = None) -> DataFrame:
    """Aggregates per slot of time."""
    slot = slots(F.col(at), width, slide)
    dealt = rows.withColumn("slot", F.explode(slot) if slide else slot)
    return dealt.groupBy(*by, "slot").agg(*values)


def squash(rows: DataFrame, by: list[str], at: str, width: int, order: list[str]) -> DataFrame:
    """The last row of each slot."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("x")
    return rows.withColumn("__slot", slots(F.col(at), width)).groupBy(*by, "__slot").agg(last).select("x.*", F.col("__slot").alias("slot"))


def drop_all_but(rows: DataFrame, by: list[str], order: list[str], every: int) -> DataFrame:
    """Every `every`-th row of each group, from the first."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__n", n).where((F.col("__n") - 1) % every == 0).drop("__n")


def roll_up(rows: DataFrame, levels: list[str], values: list[Column]) -> DataFrame:
    """Aggregates for all prefixes of the levels; `level` counts the levels that a row has."""
    return rows.rollup(*levels).agg(*values, (len(levels) - sum((F.grouping(c).cast("int") for c in levels), F.lit(0))).cast("int").alias("level"))


def synthesise(sets: DataFrame, template: Column) -> DataFrame:
    """A payload from each relation set."""
    return sets.withColumn("payload", template)


def compare(rows: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with `<column>_before` and `<column>_changed` against its predecessor (null before the first)."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = {f"{c}_before": F.lag(c).over(w) for c in columns}
    changed = {f"{c}_changed": F.when(F.lag(F.lit(1)).over(w).isNotNull(), ~F.lag(c).over(w).eqNullSafe(F.col(c))) for c in columns}
    return rows.withColumns(before | changed)
