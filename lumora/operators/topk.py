"""Nearest rows by vector: exact, and routed through clusters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumora.functions.vectors import METRICS, literal, squared_l2
from lumora.plans.judges import Judge
from lumora.tables import written


def sem_topk(df: DataFrame, query: list[float], k: int, *, vector_col: str, id_col: str, metric: str = "cosine", score: str = "score") -> DataFrame:
    """The k nearest rows (all if there are fewer) with their score, ties by id; null vectors come last."""
    column, less = METRICS[metric]
    scored = df.withColumn(score, column(F.col(vector_col), literal(query)))
    order = F.col(score).asc_nulls_last() if less else F.col(score).desc_nulls_last()
    return scored.orderBy(order, id_col).limit(k)


def centroids(df: DataFrame, vector_col: str, cluster_col: str) -> DataFrame:
    """cluster, centroid, n: the mean vector and the rows of each cluster, summed as vectors before the shuffle.

    Store it beside the rows, partitioned by cluster, so that a query reads neither again: see TextIndex.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    rows = df.where(F.col(vector_col).isNotNull())
    return rows.groupBy(F.col(cluster_col).alias("cluster")).agg(
        vector_to_array(Summarizer.mean(vector)).alias("centroid"), F.count(F.lit(1)).alias("n")
    )


def clustered(df: DataFrame, vector_col: str, k: int, seed: int = 7) -> DataFrame:
    """df with `cluster` by k-means, which fits on all rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("_v", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster", maxIter=20, initSteps=5).fit(rows)
    return model.transform(rows).drop("_v")


def routed_topk(
    df: DataFrame, query: list[float], k: int, *, vector_col: str, id_col: str, cluster_col: str, probes: int, metric: str = "l2",
    score: str = "score", centers: DataFrame | None = None,
) -> DataFrame:
    """The k nearest rows within the `probes` clusters whose centroids are nearest to the query.

    `centers` are stored centroids(); without them they are computed from all rows. The
    probes' clusters are few, so the rows are filtered by a list of them: of a table that is
    partitioned by cluster only those partitions are read.
    """
    near = (centers if centers is not None else centroids(df, vector_col, cluster_col)).withColumn("_d", squared_l2(F.col("centroid"), literal(query)))
    found = [r[0] for r in near.orderBy("_d", "cluster").select("cluster").limit(probes).collect()]
    return sem_topk(df.where(F.col(cluster_col).isin(found)), query, k, vector_col=vector_col, id_col=id_col, metric=metric, score=score)


def best_first(
    df: DataFrame, query: list[float], k: int, *, vector_col: str, id_col: str, cluster_col: str, centers: DataFrame | None = None
) -> DataFrame:
    """k rows in the order of their cluster's distance, then of their id: clusters are opened best first.

    Only the nearest clusters that hold k rows together are read and sorted.
    """
    near = (centers if centers is not None else centroids(df, vector_col, cluster_col)).withColumn("_d", squared_l2(F.col("centroid"), literal(query)))
    opened, rows = [], 0
    for r in near.orderBy("_d", "cluster").select("cluster", "_d", "n").limit(k).collect():  # k clusters hold k rows
        opened.append((r[0], r[1]))
        rows += r[2]
        if rows >= k:
            break
    if not opened:
        return df.limit(0)
    distance = F.coalesce(*[F.when(F.col(cluster_col) == F.lit(c), F.lit(d)) for c, d in opened])
    return df.where(F.col(cluster_col).isin([c for c, _ in opened]) & F.col(vector_col).isNotNull()).orderBy(distance, cluster_col, id_col).limit(k)


def reranked_topk(
    df: DataFrame, query: list[float], k: int, rerank: F.Column, *, vector_col: str, id_col: str, candidates: int = 40, metric: str = "dot"
) -> DataFrame:
    """The k rows with the largest `rerank` of the nearest candidates; where it is null, in the order of the first stage after the others."""
    near = sem_topk(df, query, candidates, vector_col=vector_col, id_col=id_col, metric=metric)
    first = F.col("score").asc_nulls_last() if METRICS[metric][1] else F.col("score").desc_nulls_last()
    return near.orderBy(rerank.desc_nulls_last(), first, id_col).limit(k)


def parse_ranking(text: str) -> str | None:
    """The first list of numbers of a reply, without repeats: the places of the records that it ranks, the best first."""
    text = text or ""
    start = text.find("[")
    try:
        found = json.loads(text[start : text.index("]", start) + 1]) if start >= 0 else None
    except ValueError:
        return None
    if not found or not all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in found):
        return None
    return json.dumps(list(dict.fromkeys(found)))


def judged_topk(
    candidates: DataFrame, task: str, k: int, judge: Judge, *, text_col: str, id_col: str, score: str = "score", size: int = 20, rank: str = "rank",
    errors: str | None = None,
) -> DataFrame:
    """The k best of scored candidates by a model that ranks lists of at most `size` of their texts (summaries, say), with their rank.

    A tournament: candidates are dealt to lists in the order of their score, so that the best ones meet last;
    the k best of each list go on, until one list is left. So n candidates take about n / size * (1 + 2k / size) calls
    at most. Records that a reply does not name follow in the order of their score, as do all of a list that the model gave no ranking
    of; `errors` names a column for what went wrong with a row's lists (null if nothing did).
    """
    if size < 2 * k:
        raise ValueError("a list must hold twice the rows that are asked for, so that each round leaves fewer")
    task = f"{task} Rank the records: answer with a JSON list of their places (from 0), the best first."
    names = ["_id", "_text", "_score", "_seed", "_wrong"]
    order = Window.orderBy(F.col(score).desc_nulls_last(), id_col)  # of the candidates that the first stage retrieved
    rows = candidates.select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(score).alias("_score"), (F.row_number().over(order) - 1).alias("_seed"), F.lit(None).cast("string").alias("_wrong")
    )
    rows = written(rows, "candidates")
    while True:
        n = rows.count()
        lists = max(1, -(-n // size))
        place = Window.orderBy("_seed")
        dealt = rows.withColumn("_list", (F.row_number().over(place) - 1) % lists)
        packs = dealt.groupBy("_list").agg(F.array_sort(F.collect_list(F.struct("_seed", *[x for x in names if x != "_seed"]))).alias("rows"))  # `size` of them
        packs = packs.withColumn("records", F.transform("rows", lambda x: F.coalesce(x["_text"], F.lit(""))))
        asked, reply, error = judge.ask(packs, task, ["records"], parse_ranking)
        ranking = F.from_json(reply, "array<int>")
        found = asked.select("_list", ranking.alias("ranking"), F.col(error).alias("error"), F.posexplode("rows").alias("_at", "row"))
        at = F.coalesce(F.array_position("ranking", F.col("_at")), F.lit(0))
        by = Window.partitionBy("_list").orderBy((at == 0), at, "_at")
        found = found.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= k)
        rows = written(found.select("row.*", rank, "error").withColumn("_wrong", F.coalesce("_wrong", "error")).drop("error"), "candidates")
        if lists == 1:
            own = rows.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), F.col("_score").alias(score), F.col(rank), *([F.col("_wrong").alias(errors)] if errors else []))
            return own.orderBy(rank)
        rows = rows.drop(rank)
