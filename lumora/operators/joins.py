"""Join by the similarity of vectors, blocked by pivots."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from lumora.plans.judges import fresh
from lumora.tables import sliced, written

#: Right vectors that pivots are chosen from, left ones that their use is measured on, and pivots of a length at most.
SAMPLE, ASKED, PIVOTS = 4096, 512, 1024
#: Rows on a side of two parts that meet, and numbers in a part, at most; comparisons that a task has at least, and that a copy of a row counts as.
PART, NUMBERS, LEAST, COPY = 16384, 1 << 22, 1 << 20, 400


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """A row a vector, none null or zero, each times the power of two that brings its largest number under one, which changes no cosine."""
    x = np.asarray(vectors.flatten().cast(pa.float64())).reshape(-1, width)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Points of the sample, each the farthest from those before it."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(most, len(x)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _near(angle: np.ndarray, reach: float) -> np.ndarray:
    """The cells that may hold partners of vectors with these angles to the cells' pivots."""
    return angle <= angle.min(axis=1, keepdims=True) + reach


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _useful(pivots: np.ndarray, living: np.ndarray, asking: np.ndarray, reach: float, rows: int, part: int) -> np.ndarray:
    """So many of the first pivots, one at the least, that samples of both sides cost least in comparisons and copies of rows."""
    held, asked, costs = _angles(living, pivots), _angles(asking, pivots), {}
    k = len(pivots)
    while k and len(asking):
        cell = np.bincount(held[:, :k].argmin(axis=1), minlength=k) * (rows / len(living))
        costs[k] = (_near(asked[:, :k], reach) @ (cell + COPY * np.maximum(1, np.ceil(cell / part)))).mean()
        k //= 2
    return pivots[: min(costs, key=costs.get, default=1)]


def _meeting(width_of: dict[int, int], left: list[str], right: list[str], kept: list[str], sides: tuple[str, str], score: str, threshold: float):
    """A function of batches by unit, the right rows of each before its left ones, that gives the kept columns of the pairs and the score.

    Products in single precision, whose error is bounded, find what may be over the threshold; the cosine
    of these is taken in double precision, number by number in the vectors' order, as cosine() does.
    """

    def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(x.shape[1])
        for p, q in zip(x, y, strict=True):
            total += p * q
        return total

    def side(rows: pa.RecordBatch, name: str, width: int) -> tuple:
        x = _matrix(rows.column(rows.schema.get_field_index(name)), width)
        by_number = np.ascontiguousarray(x.T)
        return rows.select([c for c in rows.schema.names if c in kept]), _unit(x).astype(np.float32), by_number, np.sqrt(summed(by_number, by_number))

    def pairs(asking: tuple, living: tuple) -> Iterator[pa.RecordBatch]:
        (rows, a, x, norm), (others, b, y, other_norm) = asking, living
        low = threshold - (len(x) + 16) * 2.0**-22
        each = max(1, NUMBERS // 2 // len(b))
        size = (rows.nbytes // max(1, rows.num_rows)) + (others.nbytes // max(1, others.num_rows)) + 8
        for at in range(0, len(a), each):
            i, j = np.divmod(np.flatnonzero((a[at : at + each] @ b.T).ravel() >= low), len(b))
            i += at
            for start in range(0, len(i), 1 << 16):
                s, t = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
                total = np.zeros(len(s))
                for p, q in zip(x, y, strict=True):
                    total += p[s] * q[t]
                found = total / (norm[s] * other_norm[t])
                good = found >= threshold
                s, t, found = s[good], t[good], found[good]
                for k in range(0, len(s), step := max(1, (8 << 20) // size)):
                    of = [c.take(pa.array(n[k : k + step])) for some, n in ((rows, s), (others, t)) for c in some.columns]
                    yield pa.RecordBatch.from_arrays([*of, pa.array(found[k : k + step])], names=[*kept, score])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, living = None, [], None
        for batch in batches:
            units, asks, cells = (np.asarray(batch.column(c)) for c in range(3))
            edges = np.flatnonzero(np.diff(units) | np.diff(asks)) + 1
            for at, end in pairwise([0, *edges.tolist(), batch.num_rows] if batch.num_rows else []):
                rows = batch.slice(at, end - at)
                if units[at] != unit:
                    unit, held, living = units[at], [], None
                if not asks[at]:
                    held.append(rows.select(right))
                elif held:
                    width = width_of[int(cells[at])]
                    living = living or side(pa.Table.from_batches(held).combine_chunks().to_batches()[0], sides[1], width)
                    yield from pairs(side(rows.select(left), sides[0], width), living)

    return body


def embedding_join(
    left: DataFrame, right: DataFrame, left_vector: str, right_vector: str, threshold: float, *, score: str = "score", sample: int = SAMPLE,
    pivots: int | None = None, part: int | None = None, vectors: bool = True,
) -> DataFrame:
    """Pairs with a cosine of at least `threshold`, and the cosine; columns of both sides must differ. No pair is lost.

    Pivots are points of a sample of the right side, for each length of vectors its own: as many as the root of
    the right rows of that length, PIVOTS at most, or fewer, down to one, if samples of both sides would so be compared and copied less. A
    right row lives in the cell of its nearest pivot; a left row asks the cells whose pivot
    is at most twice the threshold's angle farther from it than its nearest one, which the
    triangle inequality of angles proves to hold all its partners. The right rows of a cell are dealt to parts of at most `part`
    rows, those that ask it too; every two parts meet in a task, as a product of matrices whose large values are
    verified. Without `vectors` the pairs come without the vectors. Vectors that are null, zero or not finite have no partners, nor have vectors of different lengths.
    """
    spark = left.sparkSession
    sound = lambda c: F.coalesce(F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(c, lambda x: x != 0), F.lit(False))
    cell, unit, asks, row, width, across, down, start = fresh(left.join(right, F.lit(False)), "_cell", "_unit", "_asks", "_row", "_width", "_across", "_down", "_start")
    a, b = (df.where(sound(v)).withColumn(width, F.size(v)) for df, v in ((left, left_vector), (right, right_vector)))
    many, rows = ({r[0]: r[1] for r in df.groupBy(width).count().collect()} for df in (a, b))  # a row for each length
    widths = sorted(w for w in rows if w in many)

    def sampled(df: DataFrame, column: str, sizes: dict[int, int], n: int) -> dict[int, np.ndarray]:
        """For each length unit vectors of some n rows in all; any will do."""
        shares = {w: max(16, n * sizes[w] // sum(sizes.values())) for w in widths}
        of = lambda x: F.coalesce(*[F.when(F.col(width) == w, x(w)) for w in widths], F.lit(0))
        some = df.where(F.rand(7) < of(lambda w: 4.0 * shares[w] / sizes[w])).select(width, F.col(column).cast("array<double>").alias("v"))
        place = F.row_number().over(Window.partitionBy(width).orderBy(F.xxhash64("v")))
        taken: dict[int, list] = {}
        for w, v in some.withColumn("k", place).where(F.col("k") <= of(lambda w: shares[w])).select(width, "v").collect():
            taken.setdefault(w, []).append(v)
        return {w: _unit(_matrix(pa.array(taken.get(w) or [[1.0] + [0.0] * (w - 1)]), w)) for w in widths}

    reach = 2 * np.arccos(np.clip(threshold, -1, 1)) + 1e-6
    most = {w: part or max(1, min(PART, NUMBERS // w)) for w in widths}
    living, asking = (sampled(df, v, sizes, n) if widths else {} for df, v, sizes, n in ((b, right_vector, rows, sample), (a, left_vector, many, ASKED)))
    points, first, width_of = {}, 0, {}
    for w in widths:
        found = _pivots(living[w], pivots or min(PIVOTS, max(16, int(rows[w] ** 0.5))))
        points[w] = (first, found if pivots else _useful(found, living[w], asking[w], reach, rows[w], most[w]))
        width_of |= dict.fromkeys(range(first, first := first + len(points[w][1])), w)

    def cells(column: str, asked: bool):
        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, 2048, 16 << 20):
                given = batch.column(batch.schema.get_field_index(column))
                lengths, found = np.asarray(pc.list_value_length(given)), [[] for _ in range(len(given))]
                for w in set(lengths.tolist()) & set(points):
                    base, pivot = points[w]
                    at = np.flatnonzero(lengths == w)
                    angle = _angles(_unit(_matrix(given.take(pa.array(at)), w)), pivot) if len(pivot) > 1 else np.zeros((len(at), 1))
                    near = _near(angle, reach) if asked else np.arange(len(pivot))[None, :] == angle.argmin(axis=1)[:, None]
                    for i, some in zip(at.tolist(), near, strict=True):
                        found[i] = (np.flatnonzero(some) + base).tolist()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, cell])

        return body

    def placed(df: DataFrame, column: str, asked: bool) -> DataFrame:
        schema = StructType([*df.schema.fields, StructField(cell, ArrayType(IntegerType()))])
        return written(df.mapInArrow(cells(column, asked), schema).withColumn(row, F.monotonically_increasing_id()), "cells")

    one, other = placed(a.drop(width), left_vector, True), placed(b.drop(width), right_vector, False)
    askers, held = ({x[0]: x[1] for x in df.select(F.explode(cell).alias(cell)).groupBy(cell).count().collect()} for df in (one, other))  # a row for each pivot at most
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = max(LEAST, sum(n * askers.get(c, 0) for c, n in held.items()) // (4 * tasks))
    dealt, units = [], 0
    for c in sorted(set(askers) & set(held)):
        area = min(least, most[width_of[c]] ** 2)
        y = -(-held[c] // max(1, min(most[width_of[c]], int(area**0.5))))
        x = -(-askers[c] // max(1, area // -(-held[c] // y)))
        dealt.append((c, x, y, units))
        units += x * y
    table = F.broadcast(spark.createDataFrame(dealt, f"`{cell}` int, `{across}` long, `{down}` long, `{start}` long"))

    def copied(df: DataFrame, asked: bool) -> DataFrame:
        """The rows once for each unit, two parts of a cell that meet, which they are in."""
        part_of = F.pmod(F.xxhash64(row), F.col(across if asked else down))
        copies = F.sequence(F.lit(0).cast("long"), F.col(down if asked else across) - 1)
        at = F.transform(copies, lambda k: F.col(start) + (part_of * F.col(down) + k if asked else k * F.col(down) + part_of))
        found = df.withColumn(cell, F.explode(cell)).join(table, cell).withColumn(unit, F.explode(at)).withColumn(asks, F.lit(asked))
        null = lambda f: F.lit(None).cast(f.dataType).alias(f.name)
        own = lambda f, mine: F.col(f"`{f.name}`") if mine else null(f)
        return found.select(unit, asks, cell, *[own(f, asked) for f in left.schema.fields], *[own(f, not asked) for f in right.schema.fields])

    kept = [f for f in [*left.schema.fields, *right.schema.fields] if vectors or f.name not in (left_vector, right_vector)]
    schema = StructType([*[StructField(f.name, f.dataType) for f in kept], StructField(score, DoubleType())])
    body = _meeting(width_of, left.columns, right.columns, [f.name for f in kept], (left_vector, right_vector), score, threshold)
    both = copied(one, True).union(copied(other, False))
    n = min(max(1, units), max(tasks, 2000))
    return both.repartitionById(n, F.col(unit).cast("int") % n).sortWithinPartitions(unit, asks).mapInArrow(body, schema)
