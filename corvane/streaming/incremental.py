"""The incremental operators as streams: new files become index rows, calls become usage by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.tables import SCHEMAS


def changed_files(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of a batch whose content differs from what is stored under their id, or is new there."""
    fresh = batch.withColumn("content_hash", F.sha2("text", 256)).dropDuplicates(["file_id", "content_hash"])
    return fresh.join(stored.select(F.col("file_id"), F.col("content_hash")), ["file_id", "content_hash"], "left_anti")


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read the files that arrive in ``source`` and append the changed ones to ``target``, then stop.

    A batch that is run again after a failure finds its rows stored and adds nothing, so the result
    is the same as if it had run once.
    """
    incoming = spark.readStream.schema(SCHEMAS["raw_files"]).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            stored = session.read.parquet(target)
        else:
            stored = session.createDataFrame([], "file_id string, content_hash string")
        changed_files(batch, stored).write.mode("append").parquet(target)

    return incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_by_window(calls: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Calls and errors by tool and window of time of a stream or table of calls; ``ts`` without zone counts as UTC."""
    stamped = calls.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        stamped.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("ms"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "calls", "ms")
    )


def usage_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Usage by window of the events that arrive in ``source``; a window is written once it is closed."""
    events = spark.readStream.schema(schema).parquet(source)
    return usage_by_window(events).writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
