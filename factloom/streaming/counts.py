"""Incremental counts over an event stream (an extension: the analyses themselves are batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def windowed(events: DataFrame, *, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): tumbling counts; state is dropped once the watermark passes a window."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, *, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, key, n): activity of a key without a gap longer than ``gap``."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def drained(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, *, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is available into Parquet under ``path``, a folder a batch.

    With ``keys`` (update mode) every batch adds the rows it changed, and the latest of each key is
    returned: open windows too.  Without (append mode, as sessions need) rows are final: those that the
    watermark has closed.  In both, state past the watermark is dropped and a batch run again replaces
    its own folder alone.
    """

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    mode = "append" if keys is None else "update"
    query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(add).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(path)
    if keys is None:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("last"))
    return latest.select(*keys, *(F.col(f"last.{c}").alias(c) for c in rest))
