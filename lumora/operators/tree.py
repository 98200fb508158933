"""A tree of clusters over vectors: built level by level as tables, searched best first and exactly by angle bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumora.functions.vectors import dot, literal, squared_l2
from lumora.operators.relational import cell_join
from lumora.operators.topk import sem_topk
from lumora.tables import dropped, new_path, written

#: Angles are compared with this much to spare, for their rounding.
SLACK = 1e-7


#: Numbers of centers, and names of nodes, that are broadcast at most; the root of the rows of a large node that meet its centers in one task.
HELD, NAMES, SIDE = 1 << 22, 1 << 20, 256


def _unit(vector: str) -> Column:
    x = F.col(vector).cast("array<double>")
    # the norm is a value of its own here, or it would be taken anew for each number
    return F.element_at(F.transform(F.array(F.sqrt(dot(x, x))), lambda norm: F.when(norm > 0, F.transform(x, lambda v: v / norm))), 1)


def _met(rows: DataFrame, table: DataFrame, key: str, few: bool) -> DataFrame:
    """The rows with the columns of their key's one row of a table, which is broadcast if it is `few`."""
    if few:
        return rows.join(F.broadcast(table), key)
    return cell_join(rows, table.withColumnRenamed(key, "_of"), [(key, "_of")], side=SIDE).drop("_of")


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b))))


class VectorTree:
    """build(), then search(): nodes (node, parent, depth, n, leaf, center, radius) and rows with their leaf.

    A node's center is the mean direction of its rows and its radius their largest angle to it, so that
    no row of the node is nearer to a query than the query's angle to the center less the radius.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.nodes, self.rows = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/rows")

    @classmethod
    def build(
        cls, df: DataFrame, *, vector_col: str, id_col: str, path: str | None = None, branching: int = 8, leaf: int = 256, rounds: int = 3, depth: int = 24
    ) -> VectorTree:
        """Split all nodes over `leaf` rows at once, level by level, by k-means into `branching` parts.

        A node's first centers are those rows of it whose hashes are least, as many from each task and then from all;
        each round of k-means is one join of the rows with their node's centers and one aggregate of vectors
        before the shuffle. Centers of a level are broadcast while they are few; more of them meet their rows by node, where a large node's
        rows are dealt to several tasks. A node that does not part (equal vectors) stays a leaf, whatever its size. Rows whose vectors
        are null or zero are left out; all must have one length.
        """
        spark, path = df.sparkSession, path or new_path(df.sparkSession, "tree")
        # dealt by number first, as what is broadcast to the rows leaves them where they lie
        rows = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(id_col))
        rows = rows.withColumn("_unit", _unit(vector_col)).where("_unit is not null").select("*", F.lit("0").alias("node"), F.lit(True).alias("_open"))
        rows = written(rows, "tree-rows")
        first, level = rows.select(F.size("_unit")).first(), 0
        width = first[0] if first else 0
        while True:
            sizes = written(rows.where("_open").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > leaf), "tree-sizes")
            split = sizes.count()
            if level == depth or not split:
                dropped(sizes)
                break
            few = split * branching * width <= HELD
            centers = cls._centers(rows.where("_open"), sizes, id_col, branching, rounds, few)
            parts = _met(rows.where("_open"), centers, "node", few)
            child = F.when(F.size("centers") > 1, F.concat_ws(".", "node", cls._nearest("centers")))
            parts = parts.withColumn("_open", child.isNotNull()).withColumn("node", F.coalesce(child, "node")).select(rows.columns)
            # what is in no node of `sizes` is done
            done = rows.join(F.broadcast(sizes) if split <= NAMES else sizes, "node", "left_anti").withColumn("_open", F.lit(False))
            old, rows = rows, written(parts.unionByName(done.select(rows.columns)), "tree-rows")
            dropped(old, centers, sizes)
            level += 1
        # the nodes above a leaf are summed from the leaves; a row meets them all with its leaf's path
        kept = rows.withColumnRenamed("node", "leaf").drop("_open")
        leaves = written(cls._means(kept.withColumn("_n", F.lit(1.0)).groupBy("leaf"), "_n"), "tree-leaves")
        names = F.split("leaf", r"\.")
        above = leaves.select(F.explode(F.transform(names, lambda x, i: F.struct(i.alias("depth"), F.array_join(F.slice(names, F.lit(1), i + 1), ".").alias("node")))).alias("at"), F.col("leaf").alias("of"), "mean", "n")
        above = above.select("at.node", "at.depth", "of", (F.col("at.node") == F.col("of")).alias("leaf"), F.col("mean").alias("_unit"), "n")
        means = written(cls._means(above.groupBy("node", "depth", "leaf"), "n"), "tree-means")
        paths = above.select("node", "of").join(means.select("node", F.struct("node", "center").alias("at")), "node").groupBy("of").agg(F.collect_list("at").alias("path"))
        paths = written(paths.withColumnRenamed("of", "leaf"), "tree-paths")
        few = paths.count() * (level + 1) * width <= HELD
        met = _met(kept.select("leaf", "_unit", id_col), paths, "leaf", few)
        angles = met.select(F.explode(F.transform("path", lambda at: F.struct(at["node"].alias("node"), _angle(F.col("_unit"), at["center"]).alias("angle")))).alias("at"))
        radius = angles.groupBy("at.node").agg(F.max("at.angle").alias("radius"))
        nodes = means.drop("mean").join(radius, "node").withColumn("parent", F.when(F.col("depth") > 0, F.regexp_replace("node", r"\.[^.]*$", "")))
        nodes.write.partitionBy("depth").parquet(f"{path}/nodes")
        kept.repartitionByRange("leaf", id_col).sortWithinPartitions("leaf").write.parquet(f"{path}/rows")
        dropped(rows, leaves, means, paths)
        return cls(spark, path)

    @staticmethod
    def _means(grouped, weight: str) -> DataFrame:
        """The groups' keys, mean, n (the sum of the weights), center."""
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        mean = grouped.agg(
            vector_to_array(Summarizer.mean(array_to_vector("_unit"), F.col(weight).cast("double"))).alias("mean"), F.sum(weight).cast("long").alias("n")
        )
        norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
        # the mean of opposite vectors is no direction; then any one serves
        own = F.when(norm > 0, F.transform("mean", lambda x: x / norm)).otherwise(F.transform("mean", lambda x, i: F.when(i == 0, 1.0).otherwise(0.0)))
        return mean.withColumn("center", own)

    @staticmethod
    def _nearest(centers: str) -> Column:
        away = F.transform(centers, lambda c: squared_l2(F.col("_unit"), c))
        return F.array_position(away, F.array_min(away)) - 1

    @classmethod
    def _centers(cls, rows: DataFrame, sizes: DataFrame, id_col: str, branching: int, rounds: int, few: bool) -> DataFrame:
        """node, centers after some rounds of k-means in every node of `sizes`; each round is written."""
        turn = Window.partitionBy("node").orderBy("h", id_col)
        picked = rows.select("node", id_col, "_unit", F.xxhash64("_unit").alias("h")).withColumn("k", F.row_number().over(turn)).where(F.col("k") <= branching)
        picked = picked.join(sizes, "node", "left_semi")  # after the window, which leaves few rows in each task
        gathered = lambda df: written(df.groupBy("node").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"])).alias("centers")), "tree-centers")
        centers = gathered(picked.withColumnRenamed("_unit", "c"))
        for _ in range(rounds):
            near = _met(rows.select("node", "_unit", id_col), centers, "node", few).select("node", "_unit", cls._nearest("centers").alias("k"), F.lit(1.0).alias("_n"))
            old, centers = centers, gathered(cls._means(near.groupBy("node", "k"), "_n").withColumnRenamed("center", "c"))
            dropped(old)
        return centers

    def search(self, query: list[float], k: int, *, vector_col: str, id_col: str, score: str = "score", beam: int = 2) -> DataFrame:
        """The k rows with the largest cosine to the query, ties by id: exactly, without reading leaves that cannot hold one.

        A descent reads the best `beam` nodes of each level, and the leaves that it ends at; the angle of their k-th
        row bounds all others. Then one job takes the leaves whose bound is within it, and their rows. Where these
        leaves hold fewer than k rows the bound is all angles.
        """
        leaves = written(self.leaves(query, k, beam=beam).select("node"), "leaves")
        rows = self.rows.join(F.broadcast(leaves) if leaves.count() <= NAMES else leaves, F.col("leaf") == F.col("node"), "left_semi")
        return sem_topk(rows, query, k, vector_col=vector_col, id_col=id_col, score=score).drop("_unit", "leaf")

    def leaves(self, query: list[float], k: int, *, beam: int = 2) -> DataFrame:
        """node, n, bound of the leaves that can hold one of the k nearest rows."""
        norm = float(np.linalg.norm(query))
        if not norm > 0:
            return self._bounded([0.0] * len(query)).select("node", "n", F.lit(0.0).alias("bound"))
        unit = [float(x) / norm for x in query]
        nodes, ends, front, depth = self._bounded(unit), [], None, 0
        while front is None or front:
            level = nodes.where(F.col("depth") == depth)
            level = level if front is None else level.where(F.col("parent").isin(front))
            best = level.orderBy("angle", "node").limit(beam).collect()  # a beam at a time
            ends += [r.node for r in best if r.leaf]
            front, depth = [r.node for r in best if not r.leaf], depth + 1
        rows = self.rows.where(F.col("leaf").isin(ends)).select(_angle(F.col("_unit"), literal(unit)).alias("a"))
        near = rows.orderBy("a").limit(k).agg(F.max("a").alias("a"), F.count(F.lit(1)).alias("n")).first()
        reach = near.a + SLACK if near.n == k else np.pi
        return nodes.where(F.col("leaf") & (F.col("bound") <= reach)).select("node", "n", "bound")

    def _bounded(self, unit: list[float]) -> DataFrame:
        nodes = self.nodes.withColumn("angle", _angle(F.col("center"), literal(unit)))
        return nodes.withColumn("bound", F.greatest(F.lit(0.0), F.col("angle") - F.col("radius")) - SLACK)
