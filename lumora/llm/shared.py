"""What several of the operators need: written tables, runs of sorted rows, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.tables import dropped, new_path, removed, shared_dir, written

__all__ = ["dropped", "new_path", "removed", "shared_dir", "written"]


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names (new name = given name).

    All operators start with this, so extra columns with clashing names do no harm.
    """
    return df.select(*[df[given].alias(own) for own, given in columns.items()])


def binaries(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives b""."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def numbers(column: pa.Array, dtype: str = "int64") -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def runs(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys (longs): tables of whole runs, and where each run starts.

    Only the run that a batch breaks off in is held back, so memory follows the batch and
    the longest run.
    """
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[:1] = True
        for key in keys:
            x = numbers(table.column(key).combine_chunks())
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not all(held[-1].column(k)[-1].as_py() == batch.column(k)[-1].as_py() for k in keys):
            table = pa.Table.from_batches([*held, batch])
        elif held:
            held.append(batch)
            continue
        else:
            table = pa.Table.from_batches([batch])
        at = starts(table)
        if at[-1]:
            yield table.slice(0, int(at[-1])), at[:-1]
        held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node reachable from each node that has a link.

    Alternates the large-star and small-star steps (Kiveris et al., 2014), which end after
    a number of rounds logarithmic in the number of nodes. Each round is written to the
    shared folder, so a lost executor costs one round at most. The minimum of a node's
    neighbours is aggregated before the shuffle, and what joins it is split by the adaptive
    skew join, so a node with very many links lands in no single task. Loops and null ends
    are left out.
    """
    spark = links.sparkSession

    def star(edges: DataFrame, least: DataFrame) -> DataFrame:
        return edges.join(least, "u").where("v <> m").select(
            F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")
        )

    def state(edges: DataFrame) -> tuple[int, int]:
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        return row[0], row[1]

    def put(edges: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(spark, "links")
        edges.write.parquet(path)
        return path, spark.read.schema("u long, v long").parquet(path)

    path, edges = put(
        links.where(f"{a} <> {b}").select(
            F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")
        ).distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour of u moves to the least of u and its neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = star(both.where("v > u"), least).distinct()
        # small star: each smaller neighbour of u, and u, move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = star(large, least).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old, (path, edges) = path, put(small)
        removed(spark, old)
        now = state(edges)
        if now == before:
            own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)
        before = now


class Memo(dict):
    """What `make` gave for each key; the older half of a full memo goes unless it is asked for again."""

    def __init__(self, make: Callable, kept: int):
        super().__init__()
        self.make, self.kept, self.old = make, kept, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.kept:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.old = {}
        self.clear()


#: What a worker keeps from task to task, by its user: how to let go of it.
RELEASE: dict[str, Callable[[], None]] = {}


_last = [""]


def release(user: str = "") -> None:
    """Let go of what other users keep in this worker, which may serve many jobs, and give the memory back."""
    if _last[0] == user:
        return
    _last[0] = user
    for name, forget in RELEASE.items():
        if name != user:
            forget()
    trim()


def trim() -> None:
    """Give memory that is free in this worker back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, so that copies of texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def in_order(names: list[str], body: Callable, user: str = "") -> Callable:
    """For mapInArrow: yield body's dicts of arrays as batches of the given columns."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(user)
        for columns in body(batches):
            yield pa.RecordBatch.from_arrays([columns[x] for x in names], names=names)

    return step
