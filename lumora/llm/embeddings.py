"""Embedding near-duplicates by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.shared import components, in_order, narrowed, numbers, roots, runs, written

#: Vectors that pivots are chosen from, pivots at most, and the cosine at which two are too alike.
SAMPLE, PIVOTS, ALIKE = 4096, 1024, 0.5
#: Vectors of each length that pivots are chosen from at the least, where lengths differ.
LEAST = 16
#: Members and queries of a pivot's list that one cell compares.
PART = 2048
#: The share of pairs at the threshold that a description must find on the sample, and what it may be: pivots, nearest ones, shared ones.
RECALL = 0.97
SETTINGS = [(p, n, s) for p in (1024, 512, 256, 128, 64, 32, 16) for n in (4, 6, 8, 12, 16, 24, 32, 48, 64) for s in (2, 3) if n <= p]
#: Vectors that a query could be compared with for the price of one more copy of it.
COPY = 64


def _matrix(column: pa.Array, dtype: str = "float64") -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Description:
    """How vectors of one length are described: by the `nearest` of these pivots, once the sample's mean is taken off.

    What vectors have in common says nothing about which of them are near, so it is left out
    of the description; cosines are verified on the vectors as they are. `recall` and `share` are what the
    sample had: pairs at the threshold that were found, and the vectors that a query met in its lists.
    """

    mean: np.ndarray
    pivots: np.ndarray
    nearest: int
    shared: int
    recall: float = 1.0
    share: float = 1.0
    first: int = 0  # the pivots' numbers follow one another over all lengths

    def centred(self, unit: np.ndarray) -> np.ndarray:
        x = unit - self.mean
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-12)

    def near(self, unit: np.ndarray) -> np.ndarray:
        """Numbers of the nearest pivots of each vector, in order."""
        order = np.argsort(-(self.centred(unit) @ self.pivots.T), axis=1, kind="stable")[:, : self.nearest]
        return order.astype(np.int32) + np.int32(self.first)


def partners(unit: np.ndarray, cosine: float, seed: int = 7) -> list[np.ndarray]:
    """Two vectors for each at that cosine: one off in any direction, one towards another of the vectors."""
    r = np.random.default_rng(seed)
    found = []
    for toward in (r.normal(size=unit.shape), unit[r.permutation(len(unit))] + 1e-3 * r.normal(size=unit.shape)):
        off = toward - (toward * unit).sum(axis=1, keepdims=True) * unit
        norm = np.linalg.norm(off, axis=1, keepdims=True)
        off = np.divide(off, norm, out=np.zeros_like(off), where=norm > 1e-12)
        found.append(cosine * unit + np.sqrt(max(0.0, 1 - cosine * cosine)) * off)
    return found


def describe(sample: np.ndarray, threshold: float, size: int, pivots: int = PIVOTS) -> Description:
    """Fit a description on a bounded sample of unit vectors, of a table of `size`.

    Points are taken greedily so that no two have a cosine of ALIKE or more once the mean is off: a group of near copies
    gives one. Of the SETTINGS that find RECALL of the sample's partners at the threshold, of either kind, that one is
    taken whose lists and copies cost least; where none does, all vectors are compared, in cells.
    """
    own = Description(sample.mean(axis=0), sample[:1], 1, 1)
    centred = own.centred(sample)
    chosen = np.zeros((0, sample.shape[1]))
    for x in centred:
        if len(chosen) < pivots and x.any() and not (chosen @ x >= ALIKE).any():
            chosen = np.vstack([chosen, x])
    if not len(chosen):
        chosen = np.eye(1, sample.shape[1])
    others = [own.centred(x) for x in partners(sample, min(1.0, max(-1.0, threshold)))]
    best = Description(own.mean, chosen[:1], 1, 1)
    cost = size + COPY  # all pairs
    for count in sorted({min(p, len(chosen)) for p, _, _ in SETTINGS}, reverse=True):
        place = []
        for x in (centred, *others):
            order = np.argsort(-(x @ chosen[:count].T), axis=1, kind="stable")
            at = np.empty_like(order)
            np.put_along_axis(at, order, np.arange(count)[None, :], axis=1)
            place.append((order[:, 0], at))
        (first, at), rest = place[0], place[1:]
        lives = np.bincount(first, minlength=count) / len(sample)
        row = np.arange(len(sample))
        for nearest, shared in sorted({(n, s) for p, n, s in SETTINGS if n <= count}):
            asks = at < nearest
            share = float(lives @ asks.mean(axis=0))
            if share * size + COPY * nearest >= cost:
                continue
            recall = min(
                float((((to[row, first] < nearest) | (at[row, begin] < nearest)) & ((asks & (to < nearest)).sum(axis=1) >= min(shared, nearest))).mean()) for begin, to in rest
            )
            if recall >= RECALL:
                best, cost = Description(own.mean, chosen[:count], nearest, min(shared, nearest), recall, share), share * size + COPY * nearest
    return best


def choose_pivots(classes: DataFrame, threshold: float, sample: int = SAMPLE, pivots: int = PIVOTS) -> dict[int, Description]:
    """A description for each length of vectors (`width`), fitted on a sample of distinct ones by the order of their hash.

    Lengths share `sample` by their number of vectors, with LEAST each at the least.
    """
    sizes = {r[0]: r[1] for r in classes.groupBy("width").count().collect()}
    shares = {w: max(LEAST, sample * n // sum(sizes.values())) for w, n in sizes.items()}
    # hashes up to a bound hold a share, bar a rare chance, and not much more
    most = {w: min(1.0, (k + 5 * k**0.5 + 5) / sizes[w]) for w, k in shares.items()}
    bounds = [(w, (1 << 63) - 1 if x == 1.0 else int(x * (1 << 64)) - (1 << 63)) for w, x in most.items()]
    bounds = F.broadcast(classes.sparkSession.createDataFrame(bounds, "width int, bound long"))
    rows = classes.withColumn("hash", F.xxhash64("vector")).join(bounds, "width").where("hash <= bound")
    found: dict[int, list] = {w: [] for w in sizes}
    for r in sorted(rows.select("width", "hash", "rep", "vector").collect(), key=lambda r: (r.hash, r.rep)):
        if len(found[r.width]) < shares[r.width]:
            found[r.width].append(r.vector)
    made, first = {}, 0
    for width, vectors in found.items():
        made[width] = describe(_unit(np.array(vectors, dtype=np.float64)), threshold, sizes[width], pivots)
        made[width].first = first
        first += len(made[width].pivots)
    return made


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    sample: int = SAMPLE,
    pivots: int = PIVOTS,
    part: int = PART,
) -> DataFrame:
    """vec_id, n_links, component_id of every row.

    Equal vectors form a class, counted before any comparison. Each class is described by
    the ordered list of its nearest pivots, as a Description fitted on a bounded sample has it. It is a member of its first pivot's inverted
    list and asks the lists of all its pivots; of what it meets there, the classes that
    share enough pivots are candidates, verified by
    their cosine in double precision. Each length of vectors has pivots of its own. A list is cut into cells of at most about `part` members and queries, and a
    cell emits link counts and a forest, not pairs. The pivots are few and bounded, so
    their list lengths are broadcast. Where no description tells pairs at the threshold from others, all vectors of a length are one list, whose
    cells compare all of them.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers have no links, and
    vectors of different lengths none to each other. Repeated rows count as other vectors. An empty table gives none.
    """
    rows = narrowed(vectors, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long"), "vector")
    sound = F.coalesce(
        F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
        & F.exists("vector", lambda x: x != 0),
        F.lit(False),
    )
    valid = rows.where(sound & F.col("vec_id").isNotNull())
    classes = written(valid.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("width", F.size("vector")), "vector-classes")
    held = vectors.sparkSession.sparkContext.broadcast(choose_pivots(classes, threshold, sample, pivots))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                widths = numbers(some.column("width"))
                for width in np.unique(widths).tolist():
                    own = some.take(pa.array(np.flatnonzero(widths == width)))
                    x = _matrix(own.column("vector"))
                    near = held.value[width].near(_unit(x))
                    yield {"rep": own.column("rep"), "n": own.column("n"), "vector": lists(x), "near": lists(near)}

    names = ["rep", "n", "vector", "near"]
    index = written(classes.select("rep", "n", "vector", "width").mapInArrow(in_order(names, described), "rep long, n long, vector array<double>, near array<int>"), "pivot-index")
    asked = index.select(F.explode("near").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / part).alias("asking"))
    homes = index.groupBy(F.col("near")[0].alias("pivot")).agg(F.ceil(F.count(F.lit(1)) / part).alias("living"))
    lists = F.broadcast(homes.join(asked, "pivot"))  # at most one row for each pivot
    own = F.xxhash64("rep")
    members = index.withColumn("pivot", F.col("near")[0]).join(lists, "pivot").select(
        "pivot", F.pmod(own, "living").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("j"), F.lit(0).alias("role"), *names
    )
    queries = index.withColumn("pivot", F.explode("near")).join(lists, "pivot").select(
        "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("living") - 1)).alias("i"), F.pmod(own, "asking").alias("j"), F.lit(1).alias("role"), *names
    )
    key = ["pivot", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table, starts in runs(batches, key):
            table = table.combine_chunks()
            columns = {k: table.column(k).chunk(0) for k in ("role", *names)}
            role, rep, n = (numbers(columns[k]) for k in ("role", "rep", "n"))
            found: list[tuple] = []
            for a, b in zip(starts, np.append(starts[1:], len(rep)), strict=True):
                m, q = np.flatnonzero(role[a:b] == 0), np.flatnonzero(role[a:b] == 1)
                if not len(m) or not len(q):
                    continue
                # a pivot's list, so all of one length
                unit, near = _unit(_matrix(columns["vector"].slice(a, b - a))), _matrix(columns["near"].slice(a, b - a), "int32")
                used, at = np.unique(near, return_inverse=True)
                has = np.zeros((b - a, len(used)), dtype=np.float32)
                has[np.arange(b - a)[:, None], at.reshape(near.shape)] = 1
                width = unit.shape[1]
                hit = (has[q] @ has[m].T >= held.value[width].shared) & (unit[q] @ unit[m].T >= threshold)
                i, j = np.nonzero(hit)
                i, j = q[i], m[j]
                # met in both of their home lists, a pair counts where the smaller one lives
                twice = (near[i][:, :1] == near[j]).any(axis=1)
                i, j = i + a, j + a
                keep = (rep[i] != rep[j]) & (~twice | (rep[j] < rep[i]))
                i, j = i[keep], j[keep]
                if len(i):
                    nodes, at = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
                    left, right = at[: len(i)], at[len(i) :]
                    links = np.bincount(left, n[j], len(nodes)) + np.bincount(right, n[i], len(nodes))
                    found.append((nodes, links.astype(np.int64), nodes[roots(len(nodes), left, right)]))
            if found:
                yield {k: pa.array(np.concatenate(v)) for k, v in zip(("rep", "links", "root"), zip(*found, strict=True), strict=True)}

    cells = members.unionByName(queries).repartition(*key).sortWithinPartitions(*key)
    found = written(cells.mapInArrow(in_order(["rep", "links", "root"], compare), "rep long, links long, root long"), "vector-links")
    joined = components(found, "rep", "root").withColumnRenamed("node", "rep")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(joined, "rep")
    known = classes.join(linked, "rep", "left").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    whole = valid.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone)
