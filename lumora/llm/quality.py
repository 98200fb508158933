"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.shared import RELEASE, Memo, binaries, in_order, narrowed, release, sliced

#: Labelled documents that a model is fitted on at most.
SAMPLE = 16_000
#: Hash buckets of n-grams.
BUCKETS = 1 << 18

_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa"), (re.compile(r"\d+"), lambda m: "0"))


def _shape(word: str) -> str:
    """Runs of letters by their case, digits as 0, other signs as they are."""
    for pattern, to in _RUNS:
        word = pattern.sub(to, word)
    return word


def _word(raw: bytes) -> bytes:
    text = raw.decode("utf-8", "replace")
    core = "".join(_LETTERS.findall(text.lower()))
    return np.array([zlib.crc32(core.encode()), zlib.crc32(b"\0" + _shape(text).encode())], dtype="<u4").tobytes()


_words = Memo(_word, 100_000)
RELEASE["quality"] = _words.forget


def features(text: bytes) -> tuple[np.ndarray, int]:
    """Buckets of the text's n-grams, repeats included, and its number of words.

    Each word between ASCII white space counts as its letters in lower case and as its
    shape; one- and two-word sequences of both are hashed. All doubled words share a bucket.
    """
    raw = text.split()
    both = np.frombuffer(b"".join(map(_words.__getitem__, raw)), dtype="<u4").reshape(-1, 2).astype(np.uint64)
    _words.trim()
    pairs = both[:-1] * np.uint64(0x9E3779B97F4A7C15) + both[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs[both[:-1] == both[1:]] = 0
    mixed = np.concatenate([both.ravel() * np.uint64(0xD6E8FEB86659FD93), pairs.ravel()])
    return (mixed >> np.uint64(64 - 18)).astype(np.int64) % BUCKETS, len(raw)


@dataclass
class Model:
    """Weights of the buckets and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        """The probability of label 1: a sparse dot product with the n-grams' shares of the words."""
        found, n = features(text)
        z = self.bias + (float(self.weights[found].sum(dtype=np.float64)) / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def ftrl(rows: list[tuple[bytes, int]], *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 1e-3, epochs: int = 2) -> Model:
    """FTRL-proximal logistic regression over the rows in their order (McMahan et al., 2013).

    n-grams are hashed anew in each epoch: they take several times the memory of the texts.
    """
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for text, label in rows:
            found, words = features(text)
            at, count = np.unique(found, return_counts=True)
            at, x = np.append(at, BUCKETS), np.append(count / max(1, words), 1.0)
            own_z, own_n = z[at], n[at]
            w = weights(own_z, own_n)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            sigma = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / alpha
            z[at] = own_z + g - sigma * w
            n[at] = own_n + g * g
    w = weights(z, n)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def held_out(doc_id) -> F.Column:
    """True for the quarter of the ids that no model learns from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE
) -> Model:
    """A model of the labels outside the held-out quarter.

    At most `sample` labelled documents are taken, by the order of their ids' hash; that
    bound lets one task fit the model, and the labels' ids be broadcast. A document with
    several labels counts with their rounded mean, one with null labels not at all; of
    several texts of one id the least counts. Without any row all scores are 0.5.
    """
    known = narrowed(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = narrowed(docs, doc_id=id_col, text=text_col).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(F.xxhash64("doc_id").alias("at"), "doc_id", "text", "label")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        data = []
        for batch in sliced(batches):
            data += zip(binaries(batch.column("text")), batch.column("label").to_pylist(), strict=True)
        model = ftrl(data)
        yield {"weights": pa.array([model.weights.tobytes()]), "bias": pa.array([model.bias])}

    one = rows.repartition(1).sortWithinPartitions("at", "doc_id").select("text", "label")
    row = one.mapInArrow(in_order(["weights", "bias"], body, "quality"), "weights binary, bias double").first()
    if row is None:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0)
    return Model(np.frombuffer(bytes(row[0]), dtype=np.float32), row[1])


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row; null and empty texts get the score of the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches):
            scores = [held.value.score(x) for x in binaries(batch.column("text"))]
            yield {"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())}

    rows = narrowed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(in_order(["doc_id", "score"], body, "quality"), "doc_id long, score double")


def kept(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores at least `threshold`, with all their columns; all of them if no label was fitted."""
    if not model.weights.any():
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("quality")
        for batch in sliced(batches):
            keep = [held.value.score(x) >= threshold for x in binaries(batch.column(text_col))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(body, docs.schema)
