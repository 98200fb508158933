"""Scores of results against the truth, each one row computed by aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators.relational import running
from lumora.tables import dropped, written

#: Distinct pairs of values whose inversions one task counts by itself.
PART = 500_000


def _ratio(a: F.Column, b: F.Column) -> F.Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def id_sets(found: DataFrame, truth: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """precision, recall, f1 of distinct ids; with an empty truth all are 1 if nothing was found, else 0.

    With a limit, recall is taken of the smaller of limit and truth, as of a query with LIMIT.
    """
    a = found.select(key).distinct().withColumn("_f", F.lit(1))
    b = truth.select(key).distinct().withColumn("_t", F.lit(1))
    counts = a.join(b, key, "full_outer").agg(
        F.count(F.when(F.col("_f").isNotNull() & F.col("_t").isNotNull(), 1)).alias("tp"), F.count("_f").alias("nf"), F.count("_t").alias("nt")
    )
    want = F.least(F.col("nt"), F.lit(limit)) if limit is not None else F.col("nt")
    p, r = _ratio(F.col("tp"), F.col("nf")), _ratio(F.col("tp"), want)
    empty = F.when(F.col("nf") == 0, 1.0).otherwise(0.0)
    scores = counts.select(
        F.when(F.col("nt") == 0, empty).otherwise(p).alias("precision"), F.when(F.col("nt") == 0, empty).otherwise(r).alias("recall")
    )
    return scores.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """The mean F1 over the classes of either column; null is a class."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).count()
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.when(F.col("t").eqNullSafe(F.col("g")), F.col("count")).otherwise(0).alias("tp"), F.col("count").alias("n")),
        F.struct(F.col("g").alias("c"), F.lit(0).cast("long").alias("tp"), F.col("count").alias("n")),
    )).alias("s")).select("s.*")
    by_class = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    return by_class.agg(F.avg(2 * F.col("tp") / F.col("n")).alias("macro_f1"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """The adjusted Rand index of two clusterings; 1 if both are trivial in the same way."""
    pairs = lambda n: n * (n - 1) / 2.0
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    s = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    x = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("x"))
    y = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("y"))
    one = s.join(F.broadcast(x)).join(F.broadcast(y))  # one row each
    expected = F.col("x") * F.col("y") / pairs(F.col("n"))
    most = (F.col("x") + F.col("y")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def omega(df: DataFrame, a: str, b: str) -> DataFrame:
    """The omega index of two clusterings without overlap: agreement of pairs over what chance gives.

    Without overlap a pair is together once or not at all, so the sums need counts only.
    """
    return adjusted_rand(df, a, b).withColumnRenamed("ari", "omega")


def omega_overlap(a: DataFrame, b: DataFrame, item: str, cluster: str) -> DataFrame:
    """The omega index of two clusterings, rows of item and cluster, in which an item may be in several clusters or in none.

    Two items agree if both clusterings put them together in the same number of clusters. Items of the same sets
    of clusters in both are one profile with a count; profiles meet through the lists of their clusters, and those
    that meet in neither clustering are what is left of all pairs. So no pair of items is ever made, and no pair of profiles that share nothing;
    the work grows with the pairs of different profiles of a cluster. Items are those that have a row; a null cluster is none. The
    index is 1 if both are alike in the sense that chance would do as well, null if there are fewer than two items.
    """
    one = lambda df, name: df.groupBy(item).agg(F.array_sort(F.collect_set(F.col(cluster).cast("string"))).alias(name))
    sets = one(a, "_a").join(one(b, "_b"), item, "full_outer")
    empty = F.array().cast("array<string>")
    profiles = sets.groupBy(F.coalesce("_a", empty).alias("a"), F.coalesce("_b", empty).alias("b")).agg(F.count(F.lit(1)).cast("decimal(20,0)").alias("n"))
    profiles = written(profiles.withColumn("p", F.struct(F.xxhash64(F.size("a"), "a", "b").alias("x"), F.xxhash64("b", F.size("b"), "a").alias("y"))), "profiles")

    def together(side: str) -> DataFrame:
        own = profiles.select("p", "n", F.explode(side).alias("c"))
        other = own.select(F.col("p").alias("q"), F.col("n").alias("m"), "c")
        return own.join(other, "c").where("p < q").groupBy("p", "q").agg(F.count(F.lit(1)).alias(f"t{side}"), F.first(F.col("n") * F.col("m")).alias(f"w{side}"))

    met = together("a").join(together("b"), ["p", "q"], "full_outer").select(
        F.coalesce("ta", F.lit(0)).alias("i"), F.coalesce("tb", F.lit(0)).alias("j"), F.coalesce("wa", "wb").alias("w")
    )
    alike = profiles.select(F.size("a").cast("long").alias("i"), F.size("b").cast("long").alias("j"), (F.col("n") * (F.col("n") - 1) / 2).alias("w"))
    table = met.unionByName(alike).groupBy("i", "j").agg(F.sum(F.col("w").cast("double")).alias("w"))
    items = profiles.agg(F.sum("n").cast("double").alias("n")).select((F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))
    nothing = items.join(F.broadcast(table.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("met"))))  # one row each
    table = written(table.unionByName(nothing.select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), (F.col("pairs") - F.col("met")).alias("w"))), "omega")
    side = lambda x: table.groupBy(F.col(x).alias("k")).agg(F.sum("w").alias(f"w{x}"))
    chance = side("i").join(side("j"), "k").agg(F.coalesce(F.sum(F.col("wi") * F.col("wj")), F.lit(0.0)).alias("chance"))
    seen = table.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("w")).otherwise(0.0)).alias("same"), F.sum("w").alias("n"))
    expected, observed = F.col("chance") / (F.col("n") * F.col("n")), F.col("same") / F.col("n")
    return seen.join(F.broadcast(chance)).select(
        F.when(F.col("n") > 0, F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected))).alias("omega")
    )


def _inversions(y: np.ndarray, n: np.ndarray) -> int:
    """Pairs whose later one has the smaller y, each n times the other's; by merging ever longer stretches, all of one length at once."""
    total, place, step = 0, np.arange(len(y)), 0
    while len(y) > 1 << step:
        group, right = place >> (step + 1), (place >> step) & 1
        order = np.lexsort((-right, -y, group))  # greater y first, of equal ones the right ones
        left = np.where(right[order] == 0, n[order], 0)
        above = np.cumsum(left) - left
        start = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
        above -= np.repeat(above[start], np.diff(np.append(start, len(y))))
        found = above * np.where(right[order] == 1, n[order], 0)
        total += (int((found >> 32).sum()) << 32) + int((found & 0xFFFFFFFF).sum())
        step += 1
    return total


def kendall(df: DataFrame, x: str, y: str, *, part: int = PART) -> DataFrame:
    """Kendall's tau-b of two columns; rows with a null are left out, null if a column has one value only.

    Rows that agree are counted first. The counts are sorted by x and y over ranges; each range counts its inversions,
    then neighbouring ranges are merged, twice as many at a time: a right row stands against the left rows of a greater y,
    which are a running sum over the pairs of ranges and y. So n log n rows are moved and no task sees more than a range.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    cells = written(cells, "cells")
    ranks = running(cells.groupBy("y").agg(F.count(F.lit(1)).alias("one")), "y", "one", "rank").select("y", "rank")  # an order in numbers
    cells_y = written(cells.join(ranks, "y").select("x", "rank", "n"), "cells")
    parts = -(-cells_y.count() // part) or 1
    rows = cells_y.repartitionByRange(parts, "x", "rank").sortWithinPartitions("x", "rank").withColumn("part", F.spark_partition_id())

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The range's rows, the first of them with its inversions."""
        held = list(batches)
        columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(3)] if held else []
        if held and len(columns[0]):
            found = _inversions(columns[1].to_numpy(), columns[2].to_numpy())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([str(found)] + [None] * (len(columns[0]) - 1), pa.string())], names=["part", "rank", "n", "d"])

    ranged = written(rows.select("part", "rank", "n").mapInArrow(own, "part int, rank long, n long, d string"), "ranges")
    inside = ranged.agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d")).first()[0] or 0
    step = 0
    while 1 << step < parts:
        left = F.shiftright("part", step).bitwiseAND(F.lit(1)) == 0
        pairs = ranged.groupBy(F.shiftright("part", step + 1).alias("g"), "rank").agg(
            F.sum(F.when(left, F.col("n")).otherwise(0)).alias("left"), F.sum(F.when(left, 0).otherwise(F.col("n"))).alias("right")
        )
        summed = running(pairs.withColumn("at", F.struct("g", "rank")), "at", "left")
        whole = ranged.groupBy(F.shiftright("part", step + 1).alias("g")).agg(F.sum(F.when(left, F.col("n")).otherwise(0)).alias("all"))
        starts = summed.groupBy("g").agg(F.min("before").alias("start")).join(whole, "g")  # a row for each pair of ranges
        above = F.col("all") - (F.col("before") - F.col("start")) - F.col("left")
        crossing = summed.join(starts, "g").agg(F.sum(F.col("right").cast("decimal(19,0)") * above.cast("decimal(19,0)")).alias("d"))
        inside += crossing.first()[0] or 0
        step += 1
    pairs_of = lambda n: F.sum(F.col(n).cast("decimal(19,0)") * (F.col(n) - 1).cast("decimal(19,0)") / 2).cast("double")
    tied = lambda *by: cells.groupBy(*by).agg(F.sum("n").alias("n")).agg(F.coalesce(pairs_of("n"), F.lit(0.0)).alias("t"))
    n0, n1, n2, n3 = (z.first()[0] for z in (cells.agg(F.sum("n").alias("n")).agg(F.coalesce(pairs_of("n"), F.lit(0.0))), tied("x"), tied("y"), tied("x", "y")))
    dropped(cells, cells_y, ranged)
    norm = (n0 - n1) ** 0.5 * (n0 - n2) ** 0.5
    tau = (n0 - n1 - n2 + n3 - 2 * float(inside)) / norm if norm > 0 else None
    return df.sparkSession.createDataFrame([(tau,)], "kendall double")


def _average_rank(df: DataFrame, x: str) -> DataFrame:
    """Each distinct value of x with its average rank; no task counts through all values."""
    counts = running(df.groupBy(x).agg(F.count(F.lit(1)).alias("n")), x, "n")
    return counts.select(x, (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"{x}_rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """The correlation of average ranks; rows with a null are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = rows.join(_average_rank(rows, x), x).join(_average_rank(rows, y), y)
    return ranked.agg(F.corr(f"{x}_rank", f"{y}_rank").alias("spearman"))


def errors(df: DataFrame, guess: str, truth: str) -> DataFrame:
    """absolute and relative error of each row; relative is infinite for a truth of 0 that was missed."""
    absolute = F.abs(F.col(guess) - F.col(truth))
    relative = F.when(F.col(truth) == 0, F.when(absolute == 0, 0.0).otherwise(float("inf"))).otherwise(absolute / F.abs(F.col(truth)))
    return df.withColumns({"absolute_error": absolute, "relative_error": relative})


def tuples(df: DataFrame, columns: list[str], key: str = "key") -> DataFrame:
    """Rows as unordered tuples of their values, to be compared by id_sets()."""
    return df.select(F.to_json(F.array_sort(F.array(*[F.col(c).cast("string") for c in columns]))).alias(key))


def mape(df: DataFrame, guess: str, truth: str) -> DataFrame:
    """mae, mape: the mean absolute and the mean relative error in per cent; infinite if a truth of 0 was missed. Rows with a null are left out."""
    rows = errors(df.where(F.col(guess).isNotNull() & F.col(truth).isNotNull()), guess, truth)
    return rows.agg(F.avg("absolute_error").alias("mae"), (F.avg("relative_error") * 100).alias("mape"))


def matched_rows(found: DataFrame, truth: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 of rows that agree on the common columns (or those given), null equal to null; repeats count.

    Of a row that one side holds n and the other m times the smaller number are hits.
    """
    columns = columns or [c for c in found.columns if c in truth.columns]
    side = lambda df, f, t: df.select(*columns, F.lit(f).alias("_f"), F.lit(t).alias("_t"))
    both = side(found, 1, 0).unionByName(side(truth, 0, 1)).groupBy(*columns).agg(F.sum("_f").alias("_f"), F.sum("_t").alias("_t"))
    counts = both.agg(F.sum(F.least("_f", "_t")).alias("hit"), F.sum("_f").alias("f"), F.sum("_t").alias("t")).na.fill(0)
    p, r = _ratio(F.col("hit"), F.col("f")), _ratio(F.col("hit"), F.col("t"))
    nothing = F.when(F.col("f") == 0, 1.0).otherwise(0.0)
    scores = counts.select(F.when(F.col("t") == 0, nothing).otherwise(p).alias("precision"), F.when(F.col("t") == 0, nothing).otherwise(r).alias("recall"))
    return scores.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: The metrics by name: each takes what its function takes.
BY_NAME = {
    "f1": id_sets, "macro_f1": macro_f1, "adjusted_rand_index": adjusted_rand, "omega_index": omega, "omega_overlap": omega_overlap, "kendall": kendall, "spearman": spearman, "mape": mape,
    "errors": errors, "rows": matched_rows,
}


def metric(name: str, *args, **options) -> DataFrame:
    """The metric of that name; an unknown one is an error that names those there are."""
    if name not in BY_NAME:
        raise ValueError(f"no metric {name!r}: one of {', '.join(sorted(BY_NAME))}")
    return BY_NAME[name](*args, **options)
