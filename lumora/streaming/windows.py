"""Windows over events with late data; the same functions take a table or a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, time_col: str, late: str) -> DataFrame:
    timed = events.withColumn("_at", F.col(time_col).cast("timestamp"))
    return timed.withWatermark("_at", late) if events.isStreaming else timed


def tumbling(events: DataFrame, length: str, keys: list[str], *, time_col: str = "ts", value_col: str = "value", late: str = "1 hour") -> DataFrame:
    """start, keys, n, total, mean of each window of so much time; a stream drops events later than `late`."""
    grouped = _timed(events, time_col, late).groupBy(F.window("_at", length).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value_col).alias("total"), F.avg(value_col).alias("mean")).select(
        F.col("w.start").alias("start"), *keys, "n", "total", "mean"
    )


def sliding(events: DataFrame, length: str, step: str, keys: list[str], *, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """start, keys, n of windows that begin every step."""
    grouped = _timed(events, time_col, late).groupBy(F.window("_at", length, step).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, keys: list[str], *, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """start, end, keys, n of each run of a key's events with pauses shorter than gap."""
    grouped = _timed(events, time_col, late).groupBy(F.session_window("_at", gap).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def read_stream(spark: SparkSession, path: str, schema, files_at_once: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write all that a stream has now as Parquet, exactly once, and stop; a later call goes on from there."""
    out = change(stream) if change else stream
    out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
