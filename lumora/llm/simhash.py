"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lumora.llm.shared import binaries, components, dropped, in_order, narrowed, numbers, roots, runs, sliced, written
from lumora.llm.suffixes import mixed

BITS = 64
#: Fingerprints of one bucket that are compared in one cell; larger buckets become cells of two parts.
PART = 2048
#: Buckets of two or more fingerprints whose keys are broadcast; more of them are joined by shuffle.
BROADCAST_ROWS = 500_000


def _hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; a shorter text is one, one without words none."""
    words = text.lower().split()
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return np.array([xxh64_intdigest(joined, seed)] * (n > 0), dtype=np.uint64)
    ends = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(ends + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pieces = zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in pieces], dtype=np.uint64)


def _majority(hashes: np.ndarray) -> np.uint64:
    """Each bit that is set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        octets = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.add.reduce(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def simhash(text: bytes, shingle: int = 5, seed: int = 42, n_words: int = 1, distinct: bool = False) -> list[int]:
    """The SimHash of a text's word shingles, repeats included unless `distinct`, as n_words 64-bit numbers.

    Words lie between ASCII white space, A-Z in lower case; a shorter text is one shingle,
    a text without words has fingerprint 0. A bit is set if it is set in over half of the
    shingles' XXH64, or of what is mixed from it for the numbers after the first.
    """
    hashes = _hashes(text, shingle, seed)
    hashes = np.unique(hashes) if distinct else hashes
    found = [_majority(hashes)]
    for i in range(1, n_words):
        found.append(_majority(mixed(hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << BITS)))))
    return [int(x) for x in found]


def row_id(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A hash of id and text, so that only equal rows share it; null text counts as empty."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.lit("\0"), F.coalesce(F.col(text), F.lit("")))


def fingerprints(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, n_words: int = 1, distinct: bool = False
) -> DataFrame:
    """doc_id, fp (the fingerprint as n_words signed longs) of each document; null text counts as empty.

    With `distinct`, repeated shingles count once and rows have their row_id() as uid.
    """
    more = ["uid"] if distinct else []

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches):
            found = [simhash(x, shingle, seed, n_words, distinct) for x in binaries(batch.column("text"))]
            flat = pa.array(np.array(found, dtype=np.uint64).reshape(-1).view(np.int64))
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * n_words)
            yield {x: batch.column(x) for x in ("doc_id", *more)} | {"fp": pa.ListArray.from_arrays(ends, flat)}

    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("uid", row_id()).select(F.col("doc_id").cast("long"), *more, "text")
    return rows.mapInArrow(in_order(["doc_id", *more, "fp"], body), f"doc_id long, {'uid long, ' if distinct else ''}fp array<long>")


def masks(distance: int, blocks: int) -> list[int]:
    """One mask for each choice of blocks - distance blocks of the fingerprint's bits.

    Fingerprints at most `distance` bits apart differ in at most so many blocks, so they agree
    under one of the masks at least.
    """
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    own = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    return [signed(sum(chosen)) for chosen in combinations(own, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks with which random fingerprints meet less than one other each.

    Any number of blocks over `distance` finds the same links; more of them make longer keys
    and more rows, so large inputs take more.
    """
    for blocks in range(distance + 1, 2 * distance + 1):
        kept = BITS * (blocks - distance) // blocks
        if n * len(masks(distance, blocks)) < 1 << kept:
            return blocks
    return 2 * distance if distance else 1


def similar_blocks(n: int, similarity: float, recall: float) -> tuple[int, int, int]:
    """Bits of a block, blocks, and the most differing bits of 256, for pairs of a Jaccard similarity.

    Such texts differ in a share p of the bits, the angle between their shingle counts. A
    block is wide enough that random fingerprints meet few others, and there are enough of them
    that a pair of just that similarity shares one with probability `recall`. The differing
    bits are those that all but one in 30,000 of such pairs stay within, four standard deviations over the mean.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    width = next(w for w in (16, 20, 24) if w == 24 or n < 1 << (w + 10))
    return width, math.ceil(math.log(1 - recall) / math.log(1 - (1 - p) ** width)), round(256 * p + 4 * math.sqrt(256 * p * (1 - p)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _links(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the distinct fingerprints x (one a row) that joins exactly what links of at most distance join.

    Stars around pivots first. Two stars that other links have not joined yet are compared
    member by member, without what the triangle inequality rules out.
    """
    n = len(x)
    star, pivots, far = np.full(n, -1), [], []
    for i in range(n):
        if star[i] < 0:
            d = _apart(x, x[i])
            star[(d <= distance) & (star < 0)] = len(pivots)
            pivots.append(i)
            far.append(d.astype(np.int16))
    far, pivots = np.array(far), np.array(pivots)
    s, member = np.nonzero(far <= distance)
    a, b = [pivots[s]], [member]
    of = roots(len(pivots), s, star[member])
    wide = np.bincount(star, minlength=len(pivots)) > 1
    near = far[:, pivots]
    for p, q in zip(*np.nonzero(np.triu((near <= 3 * distance) & (wide[:, None] | wide[None, :]), 1)), strict=True):
        if of[p] == of[q]:
            continue
        left = np.flatnonzero((star == p) & (far[q] <= 2 * distance))
        right = np.flatnonzero((star == q) & (far[p] <= 2 * distance))
        hit = np.argwhere(_apart(x[left][:, None], x[right][None, :]) <= distance)
        if len(hit):
            a.append(left[hit[:1, 0]])
            b.append(right[hit[:1, 1]])
            of[of == of[q]] = of[p]
    a, b = np.concatenate(a), np.concatenate(b)
    keep = star[a] == star[b]  # of a pivot's links to another star's members one is enough
    keep[np.unique(np.stack([a, star[b]]), axis=1, return_index=True)[1]] = True
    return a[keep], b[keep]


def links(fps: DataFrame, keys: list[Column], *, distance: int, n_words: int = 1, part: int = PART) -> DataFrame:
    """a, b: links between fingerprints (node, fp) that join all that share a key and differ in at most `distance` bits.

    The distance is that of the first n_words numbers of fp. Each fingerprint belongs to one
    bucket for each key. Buckets are counted first, by a hash of their key alone, and those of
    one are dropped: while the others are few, their keys are broadcast and the fingerprints
    of no other bucket are shuffled. A bucket over `part` is cut into parts, and each two of
    them are one cell, so no task holds a bucket whole. What is joined within a task's batch is
    emitted as stars around the least, never all pairs of a group.
    """
    words = [f"w{i}" for i in range(n_words)]
    own = F.explode(F.array(*[F.xxhash64(F.lit(i), k) for i, k in enumerate(keys)])).alias("key")
    counts = written(fps.select(own).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    keyed = fps.select("node", *[F.col("fp")[i].alias(w) for i, w in enumerate(words)], own)
    parts = F.ceil(F.col("n") / part)
    cells = (
        keyed.join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "key")
        .withColumn("own", F.pmod(F.xxhash64("node"), parts))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *words)
    )
    key = ["key", "i", "j"]

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table, starts in runs(batches, key):
            node = numbers(table.column("node").combine_chunks())
            x = np.stack([numbers(table.column(w).combine_chunks()).view(np.uint64) for w in words], axis=1)
            sizes = np.diff(np.append(starts, len(x)))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            small = np.repeat(np.where(sizes <= 32, np.arange(len(sizes)), -1), sizes)
            for step in range(1, int(min(32, sizes.max()))):
                i = np.flatnonzero((small[step:] == small[:-step]) & (small[step:] >= 0))
                i = i[_apart(x[i], x[i + step]) <= distance]
                a.append(node[i])
                b.append(node[i + step])
            for k in np.flatnonzero(sizes > 32):
                at = slice(starts[k], starts[k] + sizes[k])
                p, q = _links(x[at], distance)
                a.append(node[at][p])
                b.append(node[at][q])
            # each node to the least that it is joined to here: near copies meet under many keys, and their links are then the same
            nodes, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
            half = len(at) // 2
            least = roots(len(nodes), at[:half], at[half:])
            keep = least != np.arange(len(nodes))
            yield {"a": pa.array(nodes[keep]), "b": pa.array(nodes[least[keep]])}

    found = cells.repartition(*key).sortWithinPartitions(*key)
    return found.mapInArrow(in_order(["a", "b"], body), "a long, b long")


def _grouped(fps: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fps with component (a number) and component_id, by the links that found() gives for the distinct ones."""
    own = [F.min("uid").alias("uid")] if "uid" in fps.columns else []
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), *own).withColumn("node", F.monotonically_increasing_id())
    least = written(least, "distinct-fingerprints")
    linked = least.join(components(found(least.drop("least"))), "node").select("node", "least", "component")
    # of linked fingerprints alone; a component of very many is split by the adaptive skew join
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(ids, "component").select("node", "component", "component_id")
    of = written(least.join(linked, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")
    ), "components")
    dropped(least)
    return fps.join(of, "fp")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    seed: int = 42,
    distance: int = 4,
    blocks: int | None = None,
) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest id reachable over linked fingerprints.

    Equal fingerprints count as one while links are searched. Null texts and texts without
    words share fingerprint 0, which links like any other. Repeated rows each get a row;
    a row with null id gets the component of its fingerprint (null if no other has an id).
    An empty table gives none.
    """
    fps = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints")

    def found(distinct: DataFrame) -> DataFrame:
        chosen = masks(distance, blocks or blocks_for(distinct.count(), distance))
        return links(distinct, [F.col("fp")[0].bitwiseAND(F.lit(m)) for m in chosen], distance=distance)

    return _grouped(fps, found).select("doc_id", F.col("fp")[0].alias("fp"), "component_id")


def _alike(words: np.ndarray, own: np.ndarray, flat: np.ndarray, ends: np.ndarray, distance: int, similarity: float) -> tuple[list, list]:
    """A forest over sets that joins what pairs of at least the similarity join.

    Set k is flat[ends[k]:ends[k + 1]], sorted; pairs of over `distance` bits of words are not
    compared, and where two parts (own) meet only pairs of both.
    """
    a, b = [], []
    n, size = len(words), np.diff(ends)
    label, both = np.arange(n), own.min() != own.max()
    for i in range(n - 1):
        ok = (label[i + 1 :] != label[i]) & (np.minimum(size[i], size[i + 1 :]) >= similarity * np.maximum(size[i], size[i + 1 :]))
        if both:
            ok &= own[i + 1 :] != own[i]
        j = i + 1 + np.flatnonzero(ok)
        j = j[_apart(words[j], words[i]) <= distance]
        if not len(j):
            continue
        mine, steps = flat[ends[i] : ends[i + 1]], np.concatenate(([0], np.cumsum(size[j])))
        theirs = np.concatenate([flat[ends[k] : ends[k + 1]] for k in j])
        met = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        common = np.diff(np.concatenate(([0], np.cumsum(met)))[steps])
        for k in j[common * (1 + similarity) >= similarity * (size[i] + size[j]) - 1e-9]:
            if label[k] != label[i]:
                a.append(i)
                b.append(k)
                label[label == label[k]] = label[i]
    return a, b


def verified(
    docs: DataFrame, distinct: DataFrame, candidates: DataFrame, *, shingle: int, seed: int, distance: int, similarity: float, part: int = 1024, most: int = 1 << 20
) -> DataFrame:
    """a, b: links between nodes (node, uid, fp) whose sets of shingle hashes have a Jaccard similarity of at least `similarity`.

    They join what all such pairs do that differ in at most `distance` bits of 256 and that
    `candidates` joins. A component of candidates with over `part` nodes or `most`
    shingles is cut into parts, and each two of them are one cell that emits a forest.
    docs: doc_id, text.
    """
    reached = components(candidates)
    words = [f"w{i}" for i in range(4)]
    asked = distinct.join(reached, "node").select("uid", "node", "component", *[F.col("fp")[i].alias(w) for i, w in enumerate(words)])
    asked = written(asked, "candidates")
    names = ["node", "component", *words, "shingles"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches):
            found = [np.unique(_hashes(x, shingle, seed).view(np.int64)) for x in binaries(batch.column("text"))]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield {x: batch.column(x) for x in names[:-1]} | {"shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))}

    kinds = ", ".join(f"{x} long" for x in names[:-1]) + ", shingles array<long>"
    rows = docs.withColumn("uid", row_id()).select("uid", "text").join(asked, "uid")
    held = written(rows.select(*names[:-1], "text").mapInArrow(in_order(names, sets), kinds).dropDuplicates(["node"]), "shingle-sets")
    parts = held.groupBy("component").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / part), F.ceil(F.sum(F.size("shingles")) / most), F.lit(1)).cast("long").alias("parts")
    )
    cells = (
        held.join(parts, "component")
        .withColumn("own", F.pmod(F.xxhash64("node"), "parts"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select(*names, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    key = ["component", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table, starts in runs(batches, key):
            table = table.combine_chunks()
            node, own = numbers(table.column("node").chunk(0)), numbers(table.column("own").chunk(0))
            x = np.stack([numbers(table.column(w).chunk(0)).view(np.uint64) for w in words], axis=1)
            shingles = table.column("shingles").chunk(0)
            flat = numbers(shingles.flatten())
            ends = np.concatenate(([0], np.cumsum(numbers(shingles.value_lengths()))))
            a, b = [], []
            for s, e in zip(starts, np.append(starts[1:], len(node)), strict=True):
                p, q = _alike(x[s:e], own[s:e], flat, ends[s : e + 1], distance, similarity)
                a += node[s:e][p].tolist() if p else []
                b += node[s:e][q].tolist() if q else []
            yield {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}

    found = cells.repartition(*key).sortWithinPartitions(*key)
    return found.mapInArrow(in_order(["a", "b"], compare), "a long, b long")


def similar(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    seed: int = 42,
    similarity: float = 0.8,
    recall: float = 0.95,
) -> DataFrame:
    """doc_id, uid (row_id()), component, component_id of every row, linked if the sets of word shingles have a Jaccard similarity of at least `similarity`.

    Texts that alike differ in too many of 64 bits for whole blocks to agree for certain, so
    fingerprints are wider, and of distinct shingles: pairs of just that similarity share one of their blocks with
    probability `recall` (more similar ones nearly always) and all but one in 30,000 of these
    are candidates by the Hamming distance of 256 bits; candidates are verified by their
    sets of shingle hashes, so no other pairs link. `component` tells groups apart that share a
    component_id because unlike texts share a doc_id. Nulls, repeats and ties are as in near_duplicates().
    """
    n = docs.count()
    width, blocks, distance = similar_blocks(n, similarity, recall)
    each = BITS // width
    n_words = max(4, -(-blocks // each))
    fps = fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed, n_words=n_words, distinct=True)
    keys = [
        F.shiftrightunsigned(F.col("fp")[k // each], width * (k % each)).bitwiseAND(F.lit((1 << width) - 1)) for k in range(blocks)
    ]
    rows = narrowed(docs, doc_id=id_col, text=text_col)

    def found(distinct: DataFrame) -> DataFrame:
        candidates = links(distinct, keys, distance=distance, n_words=4)
        return verified(rows, distinct, candidates, shingle=shingle, seed=seed, distance=distance, similarity=similarity)

    return _grouped(written(fps, "fingerprints"), found).select("doc_id", "uid", "component", "component_id")
