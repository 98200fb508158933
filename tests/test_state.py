import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumora.operators import semantic
from lumora.plans.judges import Field, Judge
from lumora.streaming import state, windows

SCHEMA = "k string, ts timestamp, value double"
START = pd.Timestamp("2024-01-01")


def at(minutes):
    return (START + pd.Timedelta(minutes=minutes)).to_pydatetime()


def put(spark, path, rows):
    spark.createDataFrame([(k, at(m), v) for k, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(stream, out, checkpoint):
    query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()
    return query


def test_sessions_by_timers_over_triggers_and_a_restart(spark, tmp_path):
    place, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    first = [[("a", 0, 1.0), ("b", 3, None)], [("a", 8, 2.0), ("a", 30, 4.0)], [("a", 17, 8.0), ("b", 40, 1.0)]]  # the last but one joins two
    then = [[("a", 200, 1.0)], [("a", 1, 100.0), ("b", 205, 1.0)], [("a", 900, 0.0), ("b", 900, 0.0)]]  # one is too late
    stream = lambda: state.timed_sessions(windows.read_stream(spark, place, SCHEMA, files_at_once=1), 10 * 60_000, ["k"], late="60 minutes")
    for rows in first:
        put(spark, place, rows)
    run(stream(), out, checkpoint)
    for rows in then:
        put(spark, place, rows)
    run(stream(), out, checkpoint)
    assert spark.read.parquet(out).agg(F.sum("late")).first()[0] == 1
    kept = [r for rows in first + then for r in rows if r != ("a", 1, 100.0)]
    table = spark.createDataFrame([(k, at(m), v) for k, m, v in kept], SCHEMA)
    wanted = {tuple(r)[:5] for r in state.timed_sessions(table, 10 * 60_000, ["k"]).collect() if r.start < at(850)}
    found = [tuple(r) for r in spark.read.parquet(out).select("k", "start", "end", "n", "total").collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert {(r[0], r[3]) for r in wanted} >= {("a", 3), ("b", 1)}


class Held:
    """A value or list of state, and how often it was asked."""

    def __init__(self, calls, empty=None):
        self.calls, self.empty, self.value = calls, empty, empty

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        return self.value != self.empty

    def update(self, value):
        self.calls.append("put")
        self.value = value

    put = update

    def clear(self):
        self.value = self.empty


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []
        self.getListState, self.getValueState = lambda *_: Held(self.calls, []), lambda *_: Held(self.calls)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_calls_of_state_grow_with_keys_not_with_sessions():
    class Times:
        def __init__(self, watermark):
            self.getCurrentWatermarkInMs = lambda: watermark

    handle, processor = Handle(), state._Sessions(10, ["k"])
    processor.init(handle)
    rows = pd.DataFrame({"lumora_ms": [100 * i for i in range(50)] + [103], "lumora_value": [1.0] * 51})
    assert list(processor.handleInputRows(("a",), iter([rows]), Times(0))) == []
    assert handle.timers == [10]
    out = [r for f in processor.handleExpiredTimer(("a",), Times(1200), None) for r in f.itertuples()]
    assert [r.n for r in out] == [1, 2] + [1] * 10 and handle.timers == [10, 1210] and len(handle.calls) <= 5
    assert [r.n for f in processor.handleExpiredTimer(("a",), Times(10_000), None) for r in f.itertuples()] == [1] * 38 and len(handle.timers) == 2


def test_joined_streams_equal_the_tables(spark, tmp_path):
    a, b, out, checkpoint = (str(tmp_path / x) for x in ("a", "b", "out", "checkpoint"))
    left = lambda df: df.select("k", F.col("ts").alias("lt"), F.col("value").alias("l"))
    right = lambda df: df.select("k", F.col("ts").alias("rt"), F.col("value").alias("r"))
    made = lambda x, y: state.joined_streams(left(x), right(y), ["k"], "lt", "rt", before="5 MINUTES", after="10 MINUTES")
    for part in range(3):
        put(spark, a, [("p", part * 20 + i, float(i)) for i in range(0, 20, 3)] + [(None, part, 1.0)])
        put(spark, b, [("p", part * 20 + i, float(i)) for i in range(0, 20, 7)] + [("q", part, 1.0), (None, part, 1.0)])
        run(made(windows.read_stream(spark, a, SCHEMA, 1), windows.read_stream(spark, b, SCHEMA, 1)), out, checkpoint)  # a restart each time
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "lt", "rt", "l", "r").collect())
    wanted = rows(made(spark.read.parquet(a), spark.read.parquet(b)))
    assert wanted and rows(spark.read.parquet(out)) == wanted


def test_model_operators_on_streams(spark, tmp_path):
    place, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    judge = Judge(model=lambda prompts: [json.dumps({"kind": "high" if json.loads(p.split("\n", 1)[1])["value"] > 2 else "low"}) for p in prompts])
    change = lambda df: semantic.sem_map(df, [Field("kind")], judge, columns=["value"])
    for part in range(2):
        put(spark, place, [("a", part, 1.0 + part), ("b", part, 3.0)])
        state.each_batch(windows.read_stream(spark, place, SCHEMA, 1), out, checkpoint, change).awaitTermination()
    found = sorted((r.k, r.value, r.kind) for r in state.read_batches(spark, out).collect())
    assert found == sorted((r.k, r.value, r.kind) for r in change(spark.read.parquet(place)).collect()) and len(found) == 4
    with pytest.raises(Exception, match="stream"):
        change(windows.read_stream(spark, place, SCHEMA)).count()
