"""Files in and out: Parquet with nanosecond and unsigned columns, relation sets as JSON, tiers of a lake, scratch folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinloom.operators.relations import RELATION
from twinloom.operators.schema import assert_schema, with_zero_defaults

SET_DDL = f"sid string, st string, si string, dt string, ts bigint, r {RELATION}"


@contextmanager
def option(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session option for what is planned or started inside; it is as before afterwards."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, below spark.checkpoint.dir; it goes when the driver ends.

    Only a session of one machine may do without that option.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _OWN:
            import tempfile

            _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="scratch")
        base = _OWN[sc.applicationId]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, nanos: list[str] | None = None, zero: bool = False) -> DataFrame:
    """Parquet; with a schema, columns of other types are an error and missing ones null (or zero).

    `nanos` names nanosecond times, which are read as whole numbers and become microsecond timestamps.
    """
    with option(spark, "spark.sql.legacy.parquet.nanosAsLong", "true" if nanos else "false"):
        df = spark.read.parquet(path)
    for c in nanos or []:
        df = df.withColumn(c, F.timestamp_micros(F.expr(f"`{c}` div 1000")))
    if schema is None:
        return df
    assert_schema(df, schema)
    if zero:
        return with_zero_defaults(df, schema)
    return df.select(*(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def write_parquet(df: DataFrame, path: str, sort: list[str] | None = None, partition: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Sorted within files by `sort`, so that row groups can be skipped by their statistics."""
    w = (df.sortWithinPartitions(*sort) if sort else df).write.mode(mode)
    (w.partitionBy(*partition) if partition else w).parquet(path)


def sets_to_json(sets: DataFrame) -> DataFrame:
    return sets.select(F.to_json(F.struct("sid", "st", "si", "dt", "ts", "r")).alias("value"))


def sets_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Relation sets of one JSON object a row; a row that isn't one is in `corrupt`."""
    t = f"{SET_DDL}, corrupt string"
    return lines.select(F.from_json(column, t, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}).alias("s")).select("s.*")


def lake_path(base: str, tier: str, view: str, name: str) -> str:
    """<base>/<bronze|silver|gold>/<snapshot|deltaflow>/<name>"""
    if tier not in ("bronze", "silver", "gold") or view not in ("snapshot", "deltaflow"):
        raise ValueError(f"no such place: {tier}/{view}")
    return f"{base.rstrip('/')}/{tier}/{view}/{name}"


def bronze(stream: DataFrame, base: str, view: str, name: str, checkpoint: str, partition: list[str] | None = None, **trigger):
    """A stream into the bronze tier, as the files come: started, exactly once by its checkpoint. Default trigger: all there is."""
    w = stream.writeStream.format("parquet").option("path", lake_path(base, "bronze", view, name)).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.partitionBy(*partition) if partition else w).trigger(**(trigger or {"availableNow": True})).start()


def explicit(df: DataFrame) -> DataFrame:
    """Dates and intervals of imported rows as the engine has them: durations as nanoseconds (long), unsigned 64-bit as long if it fits, else null."""
    def one(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0 and f.dataType.precision == 20:
            return F.when(F.col(f.name) <= F.lit(2**63 - 1), F.col(f.name).cast("long")).alias(f.name)
        if isinstance(f.dataType, T.DayTimeIntervalType):
            return (F.expr(f"timestampdiff(MICROSECOND, timestamp_micros(0), timestamp_micros(0) + `{f.name}`)") * 1000).alias(f.name)
        return F.col(f.name)

    return df.select(*(one(f) for f in df.schema.fields))
