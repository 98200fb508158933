"""Documents to training sequences: each stage is one operator over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import decontamination, packing, quality, simhash, suffixes
from lumora.llm.queries import _vocabulary
from lumora.llm.shared import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, fitted on the labelled documents of sf_dir outside the held-out quarter, accepts."""
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, model, threshold=0.7)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group with 5-word shingles of similarity 0.8 or more.

    Rows of one doc_id and text count as one, unlike texts of one doc_id as others; rows without doc_id stay.
    """
    groups = simhash.similar(docs, shingle=5, similarity=0.8).where("doc_id is not null")
    first = F.min(F.struct("doc_id", "uid"))
    stay = groups.groupBy("component").agg(first.alias("first"))
    stay = written(stay.select("first.uid"), "one-of-each")
    again = groups.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(stay, "uid", "left_semi")
    again = written(again.select("uid"), "repeated-rows")
    rows = docs.withColumn("uid", simhash.row_id())
    found = rows.join(stay.join(again, "uid", "left_anti"), "uid", "left_semi").unionByName(rows.where("doc_id is null"))
    if again.limit(1).count():  # only repeated rows need to be grouped
        found = found.unionByName(rows.join(again, "uid", "left_semi").dropDuplicates(["doc_id", "text"]))
    return found.select(docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of 200 bytes that occur again, which covers passages of over 50 words."""
    return suffixes.cleaned(docs, length=200).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word window of a benchmark item."""
    found = decontamination.kept(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return found.select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of 1024."""
    return packing.pack(docs, tokenizer=_vocabulary(), capacity=1024)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("repeated_passages", unrepeated),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL expresses none of the fitted, hashed and tokenised stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
