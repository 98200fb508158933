"""An index over texts that is kept in a catalog, takes in changed rows, and is searched by text."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators.embedding import content, embed
from lumora.operators.topk import centroids, clustered, routed_topk, sem_topk
from lumora.plans.judges import fresh
from lumora.sources.catalog import Catalog, fingerprint
from lumora.tables import dropped, sliced, written

#: Characters that a model summarises at once, and of the preview that stands in for a failed summary.
SUMMARISED, PREVIEW = 50_000, 500


def summaries(
    df: DataFrame, text_col: str, model: Callable[[list[str]], list[str | None]], *, cache: str | None = None, summary: str = "summary",
    errors: str | None = None, batch: int = 64, chars: int = SUMMARISED,
) -> DataFrame:
    """df with a summary of each whole text; equal texts are summarised once, null and empty ones not at all.

    A text over `chars` is summarised in chunks, and the chunks' summaries together again, until
    one is left. `cache` is a table by content (two hashes of the text): only texts that it lacks go to the
    model, and their summaries are appended. Where the model fails, gives nothing or gives what is no shorter, the
    text's first PREVIEW characters are the summary, which the cache does not keep; the column that `errors` names says why.
    """
    spark, text = df.sparkSession, F.col(f"`{text_col}`")
    one, two, made, wrong = fresh(df, "_one", "_two", "_summary", "_wrong")
    marks = dict(zip((one, two), content(text), strict=True))
    texts = df.where(F.length(text) > 0).select(*[c.alias(k) for k, c in marks.items()], text.alias("text")).groupBy(one, two).agg(F.min("text").alias("text"))
    schema = f"`{one}` long, `{two}` long, `{made}` string, `{wrong}` string"

    def whole(texts: list[str]) -> tuple[list[str | None], list[str | None]]:
        """Summaries and errors; all texts of a batch take a round together."""
        found: list[str | None] = [None] * len(texts)
        failed: list[str | None] = [None] * len(texts)
        open_ = dict(enumerate(texts))
        while open_:
            pieces = [(i, x[at : at + chars]) for i, x in open_.items() for at in range(0, len(x), chars)]
            parts: dict[int, list[str]] = {i: [] for i in open_}
            for at in range(0, len(pieces), batch):
                some = pieces[at : at + batch]
                try:
                    replies = model([x for _, x in some])
                except Exception as e:  # these texts keep what went wrong
                    replies = [None] * len(some)
                    failed = [f"{type(e).__name__}: {e}" if i in {j for j, _ in some} else x for i, x in enumerate(failed)]
                for (i, _), reply in zip(some, replies, strict=True):
                    if not reply:
                        failed[i] = failed[i] or "the model gave no summary"
                    parts[i].append(reply or "")
            rest = {}
            for i, x in open_.items():
                joined = "\n".join(parts[i])
                if failed[i]:
                    continue
                if len(parts[i]) == 1:
                    found[i] = joined
                elif len(joined) >= len(x):
                    failed[i] = "the summaries of its chunks are no shorter than the text"
                else:
                    rest[i] = joined
            open_ = rest
        return found, failed

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sliced(batches, batch):
            found, failed = whole(rows.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.string()), pa.array(failed, pa.string())], names=[one, two, made, wrong])

    asked = held = None
    if cache is None:
        known = texts.mapInArrow(answer, schema)
    else:
        kept = "one long, two long, summary string"
        spark.createDataFrame([], kept).write.mode("append").parquet(cache)
        held = spark.read.schema(kept).parquet(cache).dropDuplicates(["one", "two"]).select(
            F.col("one").alias(one), F.col("two").alias(two), F.col("summary").alias(made), F.lit(None).cast("string").alias(wrong)
        )
        asked = written(texts.join(held, [one, two], "left_anti").mapInArrow(answer, schema), "summaries")
        asked.where(F.col(made).isNotNull()).select(F.col(one).alias("one"), F.col(two).alias("two"), F.col(made).alias("summary")).write.mode("append").parquet(cache)
        known = spark.read.schema(kept).parquet(cache).dropDuplicates(["one", "two"]).select(
            F.col("one").alias(one), F.col("two").alias(two), F.col("summary").alias(made), F.lit(None).cast("string").alias(wrong)
        ).unionByName(asked.where(F.col(made).isNull()))
    marked = df.withColumns(marks).join(known, [one, two], "left")
    own = F.when(F.length(text) > 0, F.coalesce(F.col(made), F.substring(text, 1, PREVIEW)))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (summary, errors)]
    return marked.select(*rest, own.alias(summary), *([F.col(wrong).alias(errors)] if errors else []))


def _vectors(rows: DataFrame, model: Callable, summarise: Callable | None, cache: str | None) -> DataFrame:
    """The rows with `vector`, of their text or its summary; those without one are left out."""
    rows = summaries(rows, "text", summarise, cache=cache) if summarise else rows
    return embed(rows, "summary" if summarise else "text", model).where("vector is not null")


class TextIndex:
    """build() or get(), then search(): vectors of texts, partitioned by cluster, with the clusters' centroids beside them.

    The index lies in one folder: rows by cluster and step, the ids that a step took away, and the
    centroids of each step with the sums that they are made of. update() appends a step and rewrites none.
    """

    #: Rows written in later steps or gone, as a share of the live ones, over which get() writes the live rows anew.
    MERGED = 0.5

    def __init__(self, catalog: Catalog, dataset: str, name: str, model: Callable, options: dict):
        self.catalog, self.dataset, self.name, self.model, self.options = catalog, dataset, name, model, options
        self.spark, self.place, self.step, self.id_col = catalog.spark, options["place"], options["step"], options["id_col"]

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.schema(self.options[what]).parquet(f"{self.place}/{what}")

    @property
    def rows(self) -> DataFrame:
        """id, text, one, two (of its content), vector, cluster, step of the live rows."""
        rows = self._read("rows").where(F.col("step") <= self.step)
        if not self.step:
            return rows
        gone = self._read("gone").where(F.col("until") <= self.step).select(F.col("id").alias("gone"), "until")
        return rows.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("step") < F.col("until")), "left_anti")

    @property
    def centers(self) -> DataFrame:
        """cluster, centroid, n, total (the sum of its vectors)."""
        return self.spark.read.parquet(f"{self.place}/centers/{self.step}")

    @staticmethod
    def _source(df: DataFrame, id_col: str, text_col: str, cluster_col: str | None) -> DataFrame:
        one, two = content(F.col(f"`{text_col}`"))
        own = [F.col(f"`{cluster_col}`").alias("cluster")] if cluster_col else []
        return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), one.alias("one"), two.alias("two"), *own)

    @classmethod
    def build(
        cls, catalog: Catalog, dataset: str, name: str, df: DataFrame, *, id_col: str, text_col: str, model: Callable[[list[str]], list[list[float]]],
        clusters: int | None = None, cluster_col: str | None = None, summarise: Callable | None = None, cache: str | None = None, mark: tuple | None = None,
        vectors: DataFrame | None = None,
    ) -> TextIndex:
        """Embed the texts of df (or their summaries) and register the index with a fingerprint of the rows.

        Clusters are those of `cluster_col`, or found by k-means: `clusters` of them, by default
        a tenth of the rows, 2 at least and 200 at most. Rows without a vector are not indexed.
        `vectors` (one, two, vector) are known vectors by content; only other texts go to the model.
        """
        mark = mark or fingerprint(df.select(id_col, text_col, *([cluster_col] if cluster_col else [])))
        rows = cls._source(df, id_col, text_col, cluster_col)
        # written, so that the model is asked once however often the clusters are fitted
        rows = held = written(_known(rows, vectors, model, summarise, cache), "vectors")
        if not cluster_col:
            n = rows.count()
            rows = clustered(rows, "vector", clusters or min(200, max(2, n // 10))) if n > 1 else rows.withColumn("cluster", F.lit(0))
        names = ["id", "text", "one", "two", "vector", "cluster"]
        kinds = dict(rows.dtypes)
        options = {"place": f"{catalog.path.rstrip('/')}_files/{uuid.uuid4().hex}", "step": 0, "id_col": id_col, "source": list(mark), "written": 0,
                   "rows": ", ".join(f"{x} {kinds[x]}" for x in names) + ", step int", "gone": f"id {kinds['id']}, until int"}
        made = cls(catalog, dataset, name, model, options)
        made._append(rows.select(*names), 0)
        made._centers(centroids(made._read("rows"), "vector", "cluster"), 0)
        dropped(held)
        catalog.register("index", dataset, name, made.place, **options)
        return made

    def _append(self, rows: DataFrame, step: int) -> None:
        """A folder for each cluster and step; a failed attempt at a step leaves what the next one writes over."""
        rows = rows.withColumn("step", F.lit(step))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cluster", "step").parquet(f"{self.place}/rows")

    def _centers(self, centers: DataFrame, step: int) -> None:
        kept = centers.select("cluster", "centroid", "n", F.transform("centroid", lambda x: x * F.col("n")).alias("total"))
        kept.write.mode("overwrite").parquet(f"{self.place}/centers/{step}")

    @classmethod
    def get(cls, catalog: Catalog, dataset: str, name: str, df: DataFrame, *, id_col: str, text_col: str, model: Callable, **options) -> TextIndex:
        """The registered index of just these rows: as it is, brought up to date, or built if there is none or it is marked stale.

        The source is read and hashed once to see if anything changed.
        """
        entry = catalog.entry("index", dataset, name)
        cluster_col = options.get("cluster_col")
        mark = fingerprint(df.select(id_col, text_col, *([cluster_col] if cluster_col else [])))
        if entry is None or entry["stale"]:
            return cls.build(catalog, dataset, name, df, id_col=id_col, text_col=text_col, model=model, mark=mark, **options)
        found = cls(catalog, dataset, name, model, json.loads(entry["options"]))
        if found.options["source"] == list(mark):
            return found
        found.update(df, text_col=text_col, mark=mark, cluster_col=cluster_col, summarise=options.get("summarise"), cache=options.get("cache"))
        if found.options["written"] > cls.MERGED * max(1, found.centers.agg(F.sum("n")).first()[0] or 0):
            vectors = found.rows.select("one", "two", "vector")
            return cls.build(catalog, dataset, name, df, id_col=id_col, text_col=text_col, model=model, mark=mark, vectors=vectors, **options)
        return found

    def update(
        self, df: DataFrame, *, text_col: str, mark: tuple | None = None, cluster_col: str | None = None, summarise: Callable | None = None, cache: str | None = None
    ) -> None:
        """Take in the rows of df in place of the present ones; only ids whose texts (or cluster) changed are written.

        Rows are compared by id and content. Texts that the index knows under any id keep their
        vectors, so the model is asked for new texts alone. A new row goes to its own cluster or to that with the nearest centroid;
        centroids follow from their sums, with what came added and what went taken away.
        """
        step, rows = self.step + 1, self.rows
        keys = ["id", "one", "two", *(["cluster"] if cluster_col else [])]
        source = self._source(df, self.id_col, text_col, cluster_col)
        now = source.where(F.length("text") > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("now"))
        was = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("was")).select(*[F.col(k).alias(f"_{k}") for k in keys], "was")
        differ = now.join(was, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full_outer").where("now is null or was is null or now <> was")
        changed = written(differ.select(F.when(F.col("now").isNull(), F.col("_id")).otherwise(F.col("id")).alias("changed")).distinct(), "changed-ids")
        of_changed = F.col("id").eqNullSafe(F.col("changed"))
        went = written(rows.join(changed, of_changed, "left_semi"), "gone-rows")
        came = written(_known(source.join(changed, of_changed, "left_semi"), rows.select("one", "two", "vector"), self.model, summarise, cache), "new-rows")
        if not cluster_col:
            came = _nearest(came, self.centers)
        self._append(came.select("id", "text", "one", "two", "vector", "cluster"), step)
        went.select("id", F.lit(step).alias("until")).distinct().write.mode("append").parquet(f"{self.place}/gone")
        sums = self.centers.select("cluster", "total", "n")
        for part, sign in ((came, 1), (went, -1)):
            own = centroids(part, "vector", "cluster")
            sums = sums.unionByName(own.select("cluster", F.transform("centroid", lambda x: x * F.col("n") * F.lit(sign)).alias("total"), (F.col("n") * F.lit(sign)).alias("n")))
        size = F.max(F.size("total"))
        added = sums.groupBy("cluster").agg(F.collect_list("total").alias("parts"), F.sum("n").alias("n"), size.alias("size")).where("n > 0")  # three parts at most
        total = F.aggregate("parts", F.array_repeat(F.lit(0.0), F.col("size")), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
        self._centers(added.select("cluster", F.transform(total, lambda x: x / F.col("n")).alias("centroid"), "n"), step)
        self.step = step
        self.options |= {"step": step, "source": list(mark or fingerprint(df.select(self.id_col, text_col, *([cluster_col] if cluster_col else [])))),
                         "written": self.options["written"] + came.count() + went.count()}
        self.catalog.register("index", self.dataset, self.name, self.place, **self.options)

    def search(self, query: str, k: int, *, probes: int | None = None, metric: str = "cosine", score: str = "score") -> DataFrame:
        """id, text, cluster, score of the k nearest texts (all if there are fewer): exact, or within the `probes` nearest clusters."""
        vector = [float(x) for x in self.model([query])[0]]
        options = {"vector_col": "vector", "id_col": "id", "metric": metric, "score": score}
        if probes is None:
            found = sem_topk(self.rows, vector, k, **options)
        else:
            found = routed_topk(self.rows, vector, k, cluster_col="cluster", probes=probes, centers=self.centers, **options)
        return found.select(F.col("id").alias(self.id_col), "text", "cluster", score)


def _known(rows: DataFrame, vectors: DataFrame | None, model: Callable, summarise: Callable | None, cache: str | None) -> DataFrame:
    """The rows with `vector`: known ones by content, the others' by the model; rows without one are left out."""
    names = [*rows.columns, "vector"]
    if vectors is None:
        return _vectors(rows, model, summarise, cache).select(*names)
    had = vectors.groupBy("one", "two").agg(F.first("vector").alias("vector"))
    old = rows.join(had, ["one", "two"])
    new = _vectors(rows.join(had, ["one", "two"], "left_anti"), model, summarise, cache)
    return old.select(*names).unionByName(new.select(*names))


def _nearest(rows: DataFrame, centers: DataFrame) -> DataFrame:
    """The rows with the cluster whose centroid is nearest. The centroids are those of k-means, a bounded number."""
    held = centers.select("cluster", "centroid").orderBy("cluster").collect()
    points = np.array([r.centroid for r in held], dtype=np.float64)
    clusters = np.array([r.cluster for r in held], dtype=np.int32)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.schema.get_field_index("vector")).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            if len(x):
                near = ((x**2).sum(axis=1)[:, None] - 2 * x @ points.T + (points**2).sum(axis=1)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters[near])], names=[*batch.schema.names, "cluster"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(body, f"{schema}, cluster int")
