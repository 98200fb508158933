"""Vectors of texts: by a model in batches, or by hashed words, which needs none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.plans.judges import fresh
from lumora.tables import sliced


def content(text: Column) -> tuple[Column, Column]:
    """Two hashes of a text, 128 bits together, by which equal texts are known."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def embed(
    df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]], *, max_chars: int = 32_000, batch: int = 256, vector: str = "vector"
) -> DataFrame:
    """df with the vector of each text; null and empty texts have none.

    Equal texts are embedded once and met again by 128 bits of hashes, so that only vectors and hashes are
    shuffled back. A text over max_chars is embedded in chunks whose vectors are averaged, in the task that has it.
    """
    one, two = fresh(df, "_one", "_two")
    marks = dict(zip((one, two), content(F.col(f"`{text_col}`")), strict=True))
    text = F.col(f"`{text_col}`").alias("text")
    texts = df.where(F.length(f"`{text_col}`") > 0).select(*[c.alias(k) for k, c in marks.items()], text).groupBy(one, two).agg(F.min("text").alias("text"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches, batch):
            given = rows.column(2).to_pylist()
            sizes = [-(-len(x) // max_chars) for x in given]
            pieces = [x[at : at + max_chars] for x in given for at in range(0, len(x), max_chars)]
            found = np.array([v for at in range(0, len(pieces), batch) for v in model(pieces[at : at + batch])], dtype=np.float64)
            if len(found) > len(given):
                starts = np.cumsum([0, *sizes[:-1]])
                found = np.add.reduceat(found, starts, axis=0) / np.array(sizes)[:, None]
            if len(given):
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(given) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), values], names=[one, two, vector])

    found = texts.mapInArrow(answer, f"`{one}` long, `{two}` long, `{vector}` array<double>")
    return df.withColumns(marks).join(found, [one, two], "left").select(*[F.col(f"`{c}`") for c in df.columns if c != vector], F.col(f"`{vector}`"))


def hashed_words(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """id, bucket, weight: each text's words counted in dim buckets of their MD5, with norm 1; a sparse vector.

    Words lie between white space, in lower case. Texts without words have no rows.
    """
    words = df.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"([^ \n\r\t]+)"))).alias("_w"))
    bucket = F.conv(F.substring(F.md5("_w"), 1, 6), 16, 10).cast("long") % dim
    counts = words.groupBy(id_col, bucket.alias("bucket")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    norms = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"))
    return counts.join(norms, id_col).select(id_col, "bucket", (F.col("_n") / F.col("_norm")).alias("weight"))


def nearest_texts(vectors: DataFrame, query: DataFrame, id_col: str, k: int) -> DataFrame:
    """id, score of the k rows of hashed_words() with the largest cosine to the one query, ties by id."""
    asked = query.select("bucket", F.col("weight").alias("_q"))  # at most dim rows
    scores = vectors.join(F.broadcast(asked), "bucket").groupBy(id_col).agg(F.round(F.sum(F.col("weight") * F.col("_q")), 6).alias("score"))
    return scores.orderBy(F.desc("score"), id_col).limit(k)
