"""Stateful streams. Their processors run over batches too, which need the session's stream manager to be up."""

from pyspark.sql import DataFrame

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ready(df: DataFrame) -> DataFrame:
    """df, with the stream manager (and with it the coordinator of state stores) started."""
    df.sparkSession.streams.active  # noqa: B018
    return df


def started(stream: DataFrame, sink, checkpoint: str, mode: str = "append", **trigger):
    """The stream to sink(batch, n), with the state store that timers need. Default trigger: all there is, then stop.

    trigger: availableNow=True, processingTime="1 minute" (an epoch of the wall clock) or continuous. A stream is paused
    by stop() and goes on from its checkpoint when it is started again.
    """
    from twinloom.sources.files import option

    with option(stream.sparkSession, STATE_STORE, ROCKS):
        return stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the stream gives until its source has no more, with `batch`; a batch that comes again replaces itself."""
    from twinloom.sources.files import scratch

    spark, path = stream.sparkSession, scratch(stream.sparkSession, name)

    def sink(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={n}")

    started(stream, sink, f"{path}/checkpoint", mode).awaitTermination()
    schema = stream.schema.add("batch", "long")
    if not spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/rows")
