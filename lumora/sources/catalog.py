"""A catalog of data sets and indexes, kept as Parquet tables that are appended to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "kind string, dataset string, name string, uri string, options string, fingerprint long, n_rows long, stale boolean, removed boolean, at timestamp"


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """A hash of the rows whatever their order, and their number: tells if an index is of these rows.

    The exclusive or of the rows' hashes, and two sums of 24 bits of each, which no number of rows up to 2**39 overflows.
    """
    own = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    part = lambda shift: F.sum(F.shiftrightunsigned("h", shift).bitwiseAND(F.lit((1 << 24) - 1)))
    row = own.agg(F.bit_xor("h").alias("x"), part(0).alias("a"), part(24).alias("b"), F.count(F.lit(1)).alias("n")).select(F.xxhash64("x", "a", "b"), "n").first()
    return row[0], row[1]


class Catalog:
    """Entries by kind, data set and name; the latest one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, **entry) -> None:
        row = {"options": "{}", "uri": None, "fingerprint": None, "n_rows": None, "stale": False, "removed": False} | entry
        rows = self.spark.createDataFrame([row], SCHEMA.replace(", at timestamp", "")).withColumn("at", F.current_timestamp())
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def entries(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)
        latest = Window.partitionBy("kind", "dataset", "name").orderBy(F.col("at").desc())
        return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1 and not removed").drop("_n", "removed")

    def save(self, df: DataFrame, kind: str, dataset: str, name: str, uri: str, **options) -> None:
        """Write df at uri, in a folder for each value of the option `partition`, and register it with its fingerprint."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(options["partition"]) if "partition" in options else writer).parquet(uri)
        mark, n = fingerprint(self.spark.read.parquet(uri))
        self._append(kind=kind, dataset=dataset, name=name, uri=uri, options=json.dumps(options), fingerprint=mark, n_rows=n)

    def register(self, kind: str, dataset: str, name: str, uri: str, **options) -> None:
        """An entry for what lies at uri already."""
        self._append(kind=kind, dataset=dataset, name=name, uri=uri, options=json.dumps(options))

    def entry(self, kind: str, dataset: str, name: str):
        """The latest entry, or none."""
        return self.entries().where((F.col("kind") == kind) & (F.col("dataset") == dataset) & (F.col("name") == name)).first()

    def find(self, kind: str, dataset: str, name: str, of: DataFrame | None = None) -> DataFrame | None:
        """The registered table; none if it is missing or stale, or was made of other rows than `of`."""
        row = self.entry(kind, dataset, name)
        if row is None or row["stale"]:
            return None
        if of is not None and json.loads(row["options"]).get("source") != list(fingerprint(of)):
            return None
        return self.spark.read.parquet(row["uri"])

    def _copy(self, kind: str, dataset: str, name: str, **changes) -> None:
        row = self.entry(kind, dataset, name)
        if row is not None:
            self._append(**{k: v for k, v in row.asDict().items() if k != "at"} | changes)

    def mark_stale(self, kind: str, dataset: str, name: str) -> None:
        self._copy(kind, dataset, name, stale=True)

    def remove(self, kind: str, dataset: str, name: str) -> None:
        self._copy(kind, dataset, name, removed=True)
