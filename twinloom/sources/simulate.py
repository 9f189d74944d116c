"""Simulated sources: epochs of a clock, seeded distributions, event generators. All rows are made on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def epochs(spark: SparkSession, start_ms: int, duration_ms: int, tick_ms: int, inclusive_end: bool = False, partitions: int | None = None) -> DataFrame:
    """epoch, start_ms, end_ms for every tick of a span; with inclusive_end one more that starts at its end."""
    n = -(-duration_ms // tick_ms) + (1 if inclusive_end and duration_ms % tick_ms == 0 else 0)
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    first = F.lit(start_ms) + F.col("id") * tick_ms
    return ids.select(F.col("id").alias("epoch"), first.alias("start_ms"), (first + tick_ms).alias("end_ms"))


def unbounded(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A stream of epochs without an end, paced by the wall clock."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumnRenamed("value", "epoch")


def _u(seed: int, *by: str | Column) -> Column:
    """Uniform in [0, 1) by a hash of the row's own columns: the same on every run and partitioning."""
    return F.pmod(F.xxhash64(*by, F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def uniform_int(low: int, high: int, seed: int, *by: str | Column) -> Column:
    """low to high, both included."""
    return (F.lit(low) + F.floor(_u(seed, *by) * (high - low + 1))).cast("long")


def uniform_probability(low: float, high: float, seed: int, *by: str | Column) -> Column:
    return F.lit(low) + _u(seed, *by) * (high - low)


def uniform_millis(low_ms: int, high_ms: int, seed: int, *by: str | Column) -> Column:
    """low to high, high excluded; low if the range is empty."""
    return F.lit(low_ms).cast("long") if high_ms <= low_ms else (F.lit(low_ms) + F.floor(_u(seed, *by) * (high_ms - low_ms))).cast("long")


def bounded_normal_int(mean: float, sd: float, low: int, high: int, seed: int, *by: str | Column) -> Column:
    """Normal (by Box and Muller), rounded and clipped."""
    z = F.sqrt(-2 * F.log(1 - _u(seed, *by))) * F.cos(2 * math.pi * _u(seed + 1, *by))
    return F.greatest(F.least(F.round(F.lit(mean) + z * sd), F.lit(high)), F.lit(low)).cast("long")


def poisson(mean: float, seed: int, *by: str | Column) -> Column:
    """By inversion over the terms that matter."""
    top = int(mean + 12 * math.sqrt(mean) + 12)
    total, p, cuts = 0.0, math.exp(-mean), []
    for k in range(top):
        total += p
        cuts.append(total)
        p *= mean / (k + 1)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= _u(seed, *by))).cast("long")


def fixed_rate(ops: int) -> Column:
    return F.lit(ops).cast("long")


def pool(spark: SparkSession, size: int, prefix: str) -> DataFrame:
    """`size` distinct values to issue: slot, value."""
    return spark.range(size).select(F.col("id").alias("slot"), F.concat(F.lit(prefix), F.lpad(F.col("id").cast("string"), 12, "0")).alias("value"))


def pool_counts(events: DataFrame, capacity: int) -> DataFrame:
    """Of issue (+1) and release (-1) events: issued now, ever issued, capacity."""
    last = events.groupBy("value").agg(F.max_by("change", "at").alias("c"))
    return last.agg(F.count_if(F.col("c") > 0).alias("issued"), F.count("*").alias("visited"), F.lit(capacity).cast("long").alias("capacity"))


def events(spark: SparkSession, epochs_: DataFrame, rate: Column, subject: Column) -> DataFrame:
    """For each epoch `rate` messages: epoch, n, at_ms within the epoch, subject (may use epoch and n)."""
    rows = epochs_.withColumn("__r", rate).where("__r > 0").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__r") - 1))).drop("__r")
    at = F.col("start_ms") + F.floor(_u(3, "epoch", "n") * (F.col("end_ms") - F.col("start_ms"))).cast("long")
    return rows.withColumn("at_ms", at).withColumn("subject", subject).select("epoch", "n", "at_ms", "subject")


# Domains of simulated traffic.
DIRECTIONS = {"egress": True, "ingress": False}
PROTOCOLS = ("udp", "tcp", "sctp", "ddp", "icmp")


def in_domain(value: Column, domain: tuple[str, ...]) -> Column:
    return value.isin(*domain)


def valid_port(port: Column) -> Column:
    return port.between(0, 65535)
