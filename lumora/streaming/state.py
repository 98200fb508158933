"""Streams with state: sessions that timers close, joins of two streams by time, and any change of a table batch by batch."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: The state store that timers and lists need (fixed value).
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sessions(StatefulProcessor):
    """Open sessions of a key, by start, as one value of arrays of start, last (milliseconds), n and total, read and written by one call each."""

    SCHEMA = "start array<long>, last array<long>, n array<long>, total array<double>"

    def __init__(self, gap: int, keys: list[str]):
        self.gap, self.keys = gap, keys

    def init(self, handle) -> None:
        self.handle, self.sessions, self.late = handle, handle.getValueState("open", self.SCHEMA), handle.getValueState("late", "n long")

    def close(self) -> None:
        pass

    def _held(self) -> list[tuple]:
        value = self.sessions.get()
        return list(zip(*value, strict=True)) if value else []

    def _hold(self, sessions: list[tuple]) -> None:
        """A key has one timer, for its session that ends first; later ones are set when that has gone off, so that calls grow with keys, not with sessions."""
        if sessions:
            self.sessions.update(tuple(map(list, zip(*sessions, strict=True))))
            self.handle.registerTimer(sessions[0][1] + self.gap)
        else:
            self.sessions.clear()

    def _rows(self, key, sessions: list) -> Iterator[pd.DataFrame]:
        if sessions:
            late = self.late.get()[0] if self.late.exists() else 0
            self.late.clear()
            starts, lasts, n, total = zip(*sessions, strict=True)
            at = lambda x: np.array(x, dtype="datetime64[ms]")
            yield pd.DataFrame({k: [v] * len(n) for k, v in zip(self.keys, key, strict=True)} | {"start": at(starts), "end": at([x + self.gap for x in lasts]), "n": n, "total": total, "late": [late] + [0] * (len(n) - 1)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found, open_from, late = self._held(), timerValues.getCurrentWatermarkInMs() - self.gap, 0
        for some in rows:
            came = [(int(t), int(t), 1, float(v)) for t, v in zip(some["lumora_ms"], some["lumora_value"], strict=True)]
            kept = [x for x in came if x[0] > open_from]
            late += len(came) - len(kept)
            found += kept
        if late:
            self.late.update((late + (self.late.get()[0] if self.late.exists() else 0),))
        merged: list[tuple] = []
        for start, last, n, total in sorted(found):
            if merged and start < merged[-1][1] + self.gap:
                a, b, m, s = merged[-1]
                merged[-1] = (a, max(b, last), m + n, s + total)
            else:
                merged.append((start, last, n, total))
        if merged:
            self._hold(merged)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        done = [x for x in held if x[1] + self.gap <= now]  # all that have ended; one that went on stays
        self._hold([x for x in held if x[1] + self.gap > now])
        yield from self._rows(key, done)


def timed_sessions(events: DataFrame, gap_ms: int, keys: list[str], *, time_col: str = "ts", value_col: str = "value", late: str = "1 hour") -> DataFrame:
    """keys, start, end, n, total, late of each run of a key's events with pauses shorter than the gap, as soon as the watermark has passed its end.

    Of a stream: the open sessions of each key are its state, an event may join two of them, and event-time timers close
    them. Events that come when the watermark has passed the end of the session that they would begin are dropped; `late` counts a
    key's since the row of it before. Of a table the same rows by session windows, and none is late. A null value counts as 0,
    events without a time are left out.
    """
    value = F.coalesce(F.col(value_col).cast("double"), F.lit(0.0))
    rows = events.select(*keys, F.col(time_col).cast("timestamp").alias("lumora_at"), value.alias("lumora_value")).where("lumora_at is not null")
    if not events.isStreaming:
        found = rows.groupBy(F.session_window("lumora_at", f"{gap_ms} milliseconds").alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("lumora_value").alias("total"))
        return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", F.lit(0).cast("long").alias("late"))
    # the process that sets up a stateful processor beside the driver does not get the packages shipped to executors
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = rows.withWatermark("lumora_at", late).withColumn("lumora_ms", F.unix_millis("lumora_at"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", start timestamp, end timestamp, n long, total double, late long"
    return rows.groupBy(*keys).transformWithStateInPandas(_Sessions(gap_ms, keys), schema, outputMode="Append", timeMode="EventTime")


def joined_streams(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, *, before: str, after: str, late: str = "1 hour"
) -> DataFrame:
    """Pairs of equal keys whose right time is at most `before` under and `after` over the left one; other columns must differ.

    Of streams, both sides are kept as long as the watermarks say that a partner may come, no longer.
    """
    a = left.withWatermark(left_time, late) if left.isStreaming else left
    b = right.withColumnsRenamed({k: f"_{k}" for k in on})
    b = b.withWatermark(right_time, late) if right.isStreaming else b
    near = F.expr(f"`{right_time}` >= `{left_time}` - INTERVAL {before} AND `{right_time}` <= `{left_time}` + INTERVAL {after}")
    return a.join(b, [*[F.col(k) == F.col(f"_{k}") for k in on], near]).drop(*[f"_{k}" for k in on])


def each_batch(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame]):
    """Write what `change` makes of each batch of a stream, a table, in a folder of the batch; gives the query, which ends with what there is now.

    So all operators work on streams, those that ask a model too. A batch that is run again after a failure
    writes over its own folder, so each has its rows once.
    """

    def write(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All that each_batch() has written, with the number of the batch."""
    return spark.read.parquet(path)
