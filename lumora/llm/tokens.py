"""Token ids in Parquet list columns: written in id order, read back selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.llm.encoding import encoder, slices
from lumora.llm.shared import in_order, narrowed

#: Files whose first places are broadcast; more of them are joined by shuffle.
BROADCAST_ROWS = 100_000
SCHEMA = "doc_id long, part int, before long, n_tokens long, tokens array<int>"

#: The format: row groups of 16 MB, so a reader takes few at a time; pages of at most 2,000 rows,
#: whose bounds the page index keeps; ids dictionary-encoded (16 bits and less), counts as deltas.
FORMAT = {
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "compression": "snappy",
}


def write(
    docs: DataFrame, path: str, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0
) -> None:
    """Write each document's ids, with end_id appended, in ascending id order over the files.

    The texts are dealt by id range and sorted, then encoded, so ids are never shuffled.
    `before` counts the ids of the documents before it in its file, `part` numbers the files;
    only these small columns are read to find a document's place among all. Null texts count
    as empty; rows with equal ids stay neighbours, in the order of a hash of their texts, by
    which the rows of one id (null among them, which come first) are dealt to several ranges.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, before, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for some in slices(batch):
                ids, n = own.encode_all(some.column("text"), end_id)
                ends = np.cumsum(n)
                values = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                yield {
                    "doc_id": some.column("doc_id"),
                    "part": pa.array(np.full(len(n), part, dtype=np.int32)),
                    "before": pa.array(before + ends - n),
                    "n_tokens": pa.array(n),
                    "tokens": pa.ListArray.from_arrays(offsets, values),
                }
                before += int(ends[-1])

    rows = narrowed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    rows = rows.withColumn("turn", F.xxhash64("text")).repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn").select("doc_id", "text")
    names = ["doc_id", "part", "before", "n_tokens", "tokens"]
    rows.mapInArrow(in_order(names, body, "encoder"), SCHEMA).write.options(**FORMAT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens of what write() wrote.

    Only the columns that are asked for are read; `start` needs one number for each file,
    which are broadcast up to BROADCAST_ROWS files, so the ids are not shuffled.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    base = rows.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    base = base.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("base"))
    base = F.broadcast(base) if base.count() <= BROADCAST_ROWS else base
    return rows.join(base, "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "tokens"
    )


def checked(tokens: DataFrame) -> DataFrame:
    """The rows of read() with ids_crc32, the unsigned CRC-32 of the little-endian ids, in place of the ids."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids = batch.column("tokens")
            ends = np.asarray(ids.offsets) * 4
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield {k: batch.column(k) for k in ("doc_id", "start", "n_tokens")} | {"ids_crc32": pa.array(crc, pa.int64())}

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        in_order(names, body), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
