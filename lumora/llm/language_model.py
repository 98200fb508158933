"""Stupid-backoff scores: n-gram counts partitioned by hash, joined to the documents' n-grams, summed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from lumora.llm.shared import RELEASE, Memo, binaries, narrowed, numbers, release, trim, written
from lumora.llm.suffixes import mixed

#: Bytes of text whose distinct n-grams are looked up together.
BLOCK_BYTES = 10 << 20

_hashes = Memo(lambda word: xxh64_digest(word, 5), 200_000)
RELEASE["language model"] = _hashes.forget


def _grams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n up to order: the texts' n-grams as 64-bit hashes, and the words that they end at.

    Also the words' document numbers, as the last of the second list.
    """
    release("language model")
    trim()
    words, count = [], []
    for text in texts:
        own = text.lower().split()
        count.append(len(own))
        words.append(b"".join(map(_hashes.__getitem__, own)))
        _hashes.trim()
    one = np.frombuffer(b"".join(words), dtype="<u8")
    doc = np.repeat(np.arange(len(texts)), count)
    grams, ends, at = [mixed(one)], [np.arange(len(one))], one
    for n in range(2, order + 1):
        at = mixed(at[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[n - 1 :]) if len(at) else at
        end = np.arange(n - 1, len(one)) if len(at) else np.zeros(0, dtype=np.int64)
        inside = doc[end] == doc[end - n + 1]
        grams.append(mixed(at + np.uint64(n))[inside])
        ends.append(end[inside])
    return grams, [*ends, doc]


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 2,
    alpha: float = 0.4,
    min_count: int = 1,
    leave_one_out: bool = True,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_backoff, n_unseen, log_score of every row, by counts over all of docs.

    Words lie between ASCII white space, A-Z in lower case. A word's score is the count of
    the longest n-gram that ends at it and occurs `min_count` times at least, over the count of
    that n-gram without the word (or, for a single word, all words), times alpha for each
    shorter step; a word that does not occur at all is one step below a single word that
    occurs once. With `leave_one_out` a row's own n-grams are left out of all counts, so that
    a row is scored by the others. log_score is the sum of the logarithms, n_backoff the
    number of words that took a step, n_unseen of those that do not occur. n-grams never
    cross documents.

    Rows are dealt to blocks by a hash of id and text, so a task that runs again deals them
    alike; equal rows become one with their number of copies as they arrive. The n-grams of a
    block are exploded and made distinct, and go with their
    counts to the partition of their hash, where all blocks' counts are added up. The totals
    go back to the block in the same order, and are summed there for each document. A common
    n-gram is one entry of each block, so no partition holds more than its share. There are as
    many partitions as blocks; for very large inputs raise block_bytes as far as a worker's
    memory allows (it takes some 15 times as much, as does a text longer than a block).

    Null and empty texts have no words and log_score 0; repeated rows count each and get a
    row each; an empty table gives none.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    own = F.xxhash64(F.col("doc_id").cast("string"), F.lit("\0"), "text")
    rows = rows.withColumn("block", F.pmod(own, F.lit(blocks))).repartition("block")
    rows = rows.groupBy("block", "doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    kind = docs.schema[id_col].dataType.simpleString()

    def explode(table: pa.Table) -> pa.Table:
        grams, (*ends, doc) = _grams(binaries(table.column("text").combine_chunks()), order)
        copies = numbers(table.column("copies").combine_chunks())
        flat = np.concatenate(grams)
        if (copies > 1).any():
            at = np.argsort(flat, kind="stable")
            sums = np.concatenate(([0], np.cumsum(np.concatenate([copies[doc[e]] for e in ends])[at])))
            flat = flat[at]
        else:
            flat.sort()
            sums = None
        new = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(flat))[: len(new)]
        keys, counts = flat[new], (last - new if sums is None else sums[last] - sums[new]).astype("<u4")
        part = ((keys >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=False))
        return pa.table({
            "part": pa.array(part[first].astype(np.int64)),
            "block": pa.array([table.column("block")[0].as_py()] * len(cuts), pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in cuts], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary()),
        })

    def total(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype="<u4")
        _, inverse = np.unique(keys, return_inverse=True)
        sums = np.minimum(np.bincount(inverse, counts)[inverse], 2.0**53)
        at = np.cumsum([0] + [len(x.as_py()) // 4 for x in table.column("counts")])
        return pa.table({
            "part": table.column("part"), "block": table.column("block"),
            "totals": pa.array([sums[a:b].astype("<f8").tobytes() if sums[a:b].max() >= 2**32 else sums[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            "n": pa.array(np.diff(at)),
        })

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        n_docs = left.num_rows
        grams, (*ends, doc) = _grams(binaries(left.column("text").combine_chunks()), order) if n_docs else ([], [np.zeros(0, np.int64)])
        right = right.sort_by("part")
        totals = [np.frombuffer(x.as_py(), dtype="<u4" if len(x.as_py()) == 4 * n.as_py() else "<f8").astype(np.float64) for x, n in zip(right.column("totals"), right.column("n"), strict=True)]
        cuts = np.cumsum([0, *map(len, grams)])
        inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *grams]), return_inverse=True)[1].astype(np.uint32)
        grams = [None] * len(grams)
        count = np.concatenate([np.zeros(0), *totals])[inverse]
        del totals
        for n, end in enumerate(ends if leave_one_out else ()):  # one length at a time, to take less memory
            own = inverse[cuts[n] : cuts[n + 1]].astype(np.int64) * n_docs + doc[end]
            _, own, times = np.unique(own, return_inverse=True, return_counts=True)
            count[cuts[n] : cuts[n + 1]] -= times[own]
            del own, times
        del inverse
        n_words = np.bincount(doc, minlength=n_docs)
        single = count[: cuts[1]] if grams else np.zeros(0)
        # steps below the longest n-gram there could be, and the logarithm without that of all words' number
        steps, alone = (single < 1).astype(np.int64), np.ones(len(single), dtype=bool)
        value = np.log(np.maximum(single, 1))
        before = single
        for n in range(2, len(grams) + 1):
            here, end = count[cuts[n - 1] : cuts[n]], ends[n - 1]
            kept = here >= max(1, min_count)
            hit, miss = end[kept], end[~kept]
            value[hit] = np.log(here[kept]) - np.log(before[hit - 1])
            alone[hit], steps[hit] = False, 0
            steps[miss] += 1
            before = np.zeros(len(single))
            before[end] = here
        value += steps * math.log(alpha)
        per_doc = lambda x: pa.array(np.bincount(doc, x, n_docs).astype(np.int64))
        return pa.table({
            "doc_id": left.column("doc_id"), "copies": left.column("copies"), "n_words": pa.array(n_words.astype(np.int64)),
            "n_backoff": per_doc(steps > 0), "n_unseen": per_doc(single < 1), "n_single": per_doc(alone),
            "partial": pa.array(np.bincount(doc, value, n_docs).astype(np.float64)),
        })

    # the same columns as below, so that the texts are shuffled once for both
    exploded = rows.groupBy("block").applyInArrow(explode, "part long, block long, keys binary, counts binary")
    totals = exploded.groupBy("part").applyInArrow(total, "part long, block long, totals binary, n long")
    found = rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(
        sums, f"doc_id {kind}, copies long, n_words long, n_backoff long, n_unseen long, n_single long, partial double"
    )
    found = written(found, "scores")
    words = found.agg(F.sum(F.col("n_words") * F.col("copies"))).first()[0] or 0
    others = F.greatest(F.lit(words) - (F.col("n_words") if leave_one_out else F.lit(0)), F.lit(1))
    found = found.withColumn("log_score", F.col("partial") - F.col("n_single") * F.log(others))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))  # equal rows again
    return each.select("doc_id", "n_words", "n_backoff", "n_unseen", "log_score")
