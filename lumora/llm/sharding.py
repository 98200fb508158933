"""Sharding by extendible hashing: only buckets over the byte limit split on another bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.shared import narrowed, written

#: Bits from a document's id, and as many from its row, which part repeated ids.
HALF = 48
#: Bits that one round of the directory adds, at least and at most.
FEWEST, MOST = 4, 12
#: Rows of a directory that are broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000


def _bits(digest, n: int = HALF):
    return F.lpad(F.conv(F.substring(digest, 1, n // 4), 16, 2), n, "0")


def keyed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_bytes, bits of each row; `bits` is the hash of the id that the directory looks up."""
    rows = narrowed(docs, doc_id=id_col, text=text_col)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return rows.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "bits": _bits(F.md5(name))})


def directory(keys: DataFrame, limit: int, most: int = HALF) -> list[tuple[int, DataFrame]] | None:
    """Rounds of (bits looked up, table of slot and depth): each slot's shard has its first `depth` bits.

    A round looks at some more bits of the rows in buckets that are still over the limit.
    Its slots' bytes are summed once and added up over each slot's prefixes; a slot belongs
    to its shortest prefix of at most `limit` bytes, or with a single row. Slots whose depth
    is null are over the limit and go to the next round. None if `most` bits do not do.
    """
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    step = min(MOST, max(FEWEST, (total // max(1, limit)).bit_length() + 2))
    rounds, at, left = [], 0, keys.select("bits", "n_bytes")
    while True:
        if at == most:
            return None
        wide = min(at + step, most)
        slots = left.groupBy(F.substring("bits", 1, wide).alias("slot")).agg(
            F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")
        )
        slots = written(slots, "slots")
        above = slots.withColumn("depth", F.explode(F.sequence(F.lit(at if not rounds else at + 1), F.lit(wide))))
        above = above.withColumn("prefix", F.col("slot").substr(F.lit(1), F.col("depth")))
        sums = above.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = sums.where((F.col("b") <= limit) | (F.col("n") == 1)).select("depth", "prefix")
        depths = above.select("slot", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
        table = written(slots.select("slot").join(depths, "slot", "left"), "directory")
        rounds.append((wide, table))
        over = table.where("depth is null").select("slot")
        if not over.limit(1).count():
            return rounds
        left = left.join(over, F.substring("bits", 1, wide) == F.col("slot"), "left_semi")
        at = wide


def assign(rows: DataFrame, rounds: list[tuple[int, DataFrame]]) -> DataFrame:
    """rows (with a column `bits`) with shard ("s" and the bits of its prefix) and depth."""
    depth = F.lit(None).cast("int")
    for k, (wide, table) in enumerate(rounds):
        table = table.where("depth is not null").select(F.col("slot").alias(f"slot{k}"), F.col("depth").alias(f"depth{k}"))
        if table.count() <= BROADCAST_ROWS:
            table = F.broadcast(table)
        rows = rows.join(table, F.substring("bits", 1, wide) == F.col(f"slot{k}"), "left").drop(f"slot{k}")
        depth = F.coalesce(depth, F.col(f"depth{k}"))
    rows = rows.withColumn("depth", depth).drop(*[f"depth{k}" for k in range(len(rounds))])
    return rows.withColumn("shard", F.concat(F.lit("s"), F.col("bits").substr(F.lit(1), F.col("depth"))))


def write(
    docs: DataFrame, path: str, *, limit: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = 128 << 20
) -> DataFrame:
    """Write docs as shards of at most `limit` bytes of text, several shards a Parquet file; returns the directory.

    A file has the shards that share their first bits, in order, up to about `file_bytes` of
    text: so many that a store lists few files, and a reader of one shard takes a file's
    row groups and pages by their bounds (placed(), shard()). A document over the limit has a
    shard of its own. Null ids and texts are hashed and counted as empty. Where the rows of
    one id are over the limit they part by the rows' own bits, whose numbers are written
    once with the rows, so that no lost executor changes them. An empty table writes none.
    The returned rows are shard, depth, n_docs, n_bytes.
    """
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    keys = written(rows.select("bits", "n_bytes"), "shard-keys")
    rounds = directory(keys, limit)
    if rounds is None:
        numbered = written(rows.withColumn("own", F.monotonically_increasing_id()), "numbered")
        rows = numbered.withColumn("bits", F.concat("bits", _bits(F.md5(F.col("own").cast("string"))))).drop("own")
        keys = rows.select("bits", "n_bytes")
        rounds = directory(keys, limit, 2 * HALF)
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    # a file has a range of shards, by the number that their first bits make; the rows of one id, which share all
    # bits of its hash, are dealt by groups of eight shards
    wide = files.bit_length() + 4
    number = F.conv(F.rpad(F.col("shard").substr(F.lit(2), F.lit(wide)), wide, "0"), 2, 10).cast("long")
    group = F.pmod(F.xxhash64(F.col("shard").substr(F.lit(1), F.col("depth") - 2)), F.lit(files))
    file = F.when(F.col("depth") > HALF, group).otherwise(F.shiftright(number * files, wide)).cast("int")
    found = assign(rows, rounds).select("doc_id", "text", "depth", "shard").repartitionById(files, file).sortWithinPartitions("shard")
    found.write.option("compression", "zstd").option("parquet.page.row.count.limit", "500").parquet(path)
    return assign(keys, rounds).groupBy("shard", "depth").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_bytes").alias("n_bytes"))


def placed(spark: SparkSession, path: str) -> DataFrame:
    """shard, file: where each shard lies, read from the column of shards alone."""
    rows = spark.read.schema("shard string").parquet(path)
    return rows.select("shard", F.col("_metadata.file_path").alias("file")).distinct()


def shard(spark: SparkSession, path: str, name: str, file: str | None = None) -> DataFrame:
    """The rows of one shard, from the file that placed() names; other row groups and pages are passed over."""
    return spark.read.schema("doc_id long, text string, depth int, shard string").parquet(file or path).where(F.col("shard") == name)
