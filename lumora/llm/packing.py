"""Harmonic packing: pieces in reciprocal-capacity classes, a fixed count of each class in a bin."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.llm.encoding import encoder, slices
from lumora.llm.shared import in_order, narrowed, written

#: Words that the encoder remembers for each generation: fewer than elsewhere, as pieces take memory too.
KEPT = 60_000
#: Rows of the counts of each length and task that are broadcast, so that ids are not shuffled; more are joined by shuffle.
BROADCAST_ROWS = 300_000
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, nth long"


def cuts(n: int, capacity: int = 1024, grain: int = 16) -> list[int]:
    """Lengths of the pieces of n ids: whole bins, then halves of halves down to grain, then the rest.

    All but the rest are a power-of-two part of a bin, so bins of their classes have no gap.
    """
    found = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= grain:
        if rest >= size:
            found.append(size)
            rest -= size
        size //= 2
    return found + [rest] * (rest > 0)


def pieces(
    docs: DataFrame,
    *,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    grain: int = 16,
    end_id: int = 0,
) -> DataFrame:
    """One row for each piece, with its ids (bytes, little-endian unsigned 32-bit).

    `part` and `nth` number a piece among those of its length in its task: workers count on
    their own, and the counts are added up later. Written to the shared folder, so the
    numbers hold even if executors are lost.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, part, seen = encoder(tokenizer, KEPT), TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch):
                ids, totals = own.encode_all(some.column("text"), end_id)
                rows = []
                for doc, total in zip(some.column("doc_id").to_pylist(), totals.tolist(), strict=True):
                    start = 0
                    for length in cuts(total, capacity, grain):
                        nth = seen[length] = seen.get(length, -1) + 1
                        rows.append((doc, start, length, total, part, nth))
                        start += length
                columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                ends = np.cumsum(columns[2].to_numpy()) * 4
                offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32))
                columns.insert(3, pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(ids)]))
                yield dict(zip(names, columns, strict=True))

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "part", "nth"]
    rows = narrowed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return written(rows.mapInArrow(in_order(names, body, "encoder"), PIECE), "pieces")


def pack(docs: DataFrame, *, capacity: int = 1024, grain: int = 16, **options) -> DataFrame:
    """Every piece of every document with sequence_id, offset and the sequence's padded length.

    A piece of length l belongs to the class of bins that hold capacity // l of them; a
    class's pieces are numbered over all workers and each full count of them is a sequence.
    The classes' last, incomplete bins (a number that capacity and grain bound) share
    sequences: those of power-of-two lengths in falling order, which leaves no gap, then
    the rests. A sequence is padded to capacity unless its length is a power of two.
    Null or empty texts have the end id alone; repeated rows are packed each; an empty table
    gives no rows. `options` are those of pieces().
    """
    rows = pieces(docs, capacity=capacity, grain=grain, **options)
    counts = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("own"))
    before = Window.partitionBy("length").orderBy("part")
    counts = counts.select(
        "length", "part",
        (F.sum("own").over(before) - F.col("own")).alias("base"),
        F.sum("own").over(Window.partitionBy("length")).alias("total"),
    )
    a_bin = F.floor(F.lit(capacity) / F.col("length"))
    classes = counts.groupBy("length").agg(F.first("total").alias("total")).withColumn("bins", F.floor(F.col("total") / a_bin))
    classes = classes.select("length", "bins", (F.sum("bins").over(Window.orderBy("length")) - F.col("bins")).alias("first"), F.sum("bins").over(Window.partitionBy(F.lit(0))).alias("all"))
    counts = written(counts.join(classes, "length").drop("total"), "piece-counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    whole = F.col("rank") < F.col("bins") * a_bin
    ranked = rows.join(counts, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    order = Window.partitionBy("fine").orderBy(F.col("length").desc(), "rank")
    rest = ranked.drop("ids").where(~whole).withColumn("fine", F.col("length") < grain)
    rest = rest.withColumn("at", F.sum("length").over(order) - F.col("length"))
    # a rest that begins below capacity - grain + 1 ends within capacity
    rest = rest.withColumn("bin", F.floor(F.col("at") / F.when(F.col("fine"), capacity - grain + 1).otherwise(capacity)))
    one = Window.partitionBy("fine", "bin")
    rest = rest.select(
        "length", "part", "nth",
        (F.col("all") + 2 * F.col("bin") + F.col("fine").cast("long")).alias("late_sequence"),
        (F.col("at") - F.min("at").over(one)).alias("late_offset"),
        F.sum("length").over(one).alias("late_fill"),
    )
    # fewer than capacity // l pieces of each length l, of which there are few: their number is bounded
    rest = F.broadcast(written(rest, "incomplete"))
    packed = ranked.join(rest, ["length", "part", "nth"], "left").withColumns({
        "sequence_id": F.coalesce("late_sequence", F.col("first") + F.floor(F.col("rank") / a_bin)),
        "offset": F.coalesce("late_offset", F.col("rank") % a_bin * F.col("length")),
        "fill": F.coalesce("late_fill", a_bin * F.col("length")),
    })
    power = F.col("fill").bitwiseAND(F.col("fill") - 1) == 0
    return packed.select(
        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", F.when(power, F.col("fill")).otherwise(capacity).alias("padded_length")
    )


def checked(packed: DataFrame) -> DataFrame:
    """The rows of pack() with ids_crc32, the unsigned CRC-32 of the ids' bytes, in place of the ids."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length"]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
            yield {k: crc if k == "ids_crc32" else batch.column(k) for k in names}

    return packed.mapInArrow(in_order(names, body), ", ".join(f"{x} long" for x in names))
