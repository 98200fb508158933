"""Tables that are written once in the folder that driver and executors share, and go when they are not needed."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on this machine alone a temporary folder is
    set; on a cluster no executor would see another's files, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lumora-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _store(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that does not exist yet; what lies there goes when the application ends."""
    path = f"{shared_dir(spark)}/lumora-{what}-{uuid.uuid4().hex}"
    store, target = _store(spark, path)
    store.deleteOnExit(target)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder: whatever reads it sees the same rows."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.lumora_path = path
    return made


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, table.lumora_path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that is no longer read, on whichever store it lies."""
    store, target = _store(spark, path)
    store.delete(target, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and about so many bytes of all columns, one row at the least, so that Python's copies stay small."""
    for batch in batches:
        each = max(1, min(rows, chars * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, each):
            yield batch.slice(at, each)
