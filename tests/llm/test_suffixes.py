import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumora.llm import suffixes
from tests.llm.conftest import prose


def brute(texts, length):
    """Kept bytes, removed bytes and runs of each text in a list."""
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    found = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, gone, strict=True) if not y)
        found.append((kept, sum(gone), sum(1 for i, y in enumerate(gone) if y and not (i and gone[i - 1]))))
    return found


def compare(spark, rows, length=200, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.deduplicated(df, length=length, **options).collect()
    got = Counter((r.doc_id, bytes(r.left), sum(x.end - x.start for x in r.spans), len(r.spans)) for r in found)
    texts = [(t or "").encode() for _, t in rows]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute(texts, length), strict=True))
    assert got == want


def test_awkward(spark, awkward):
    rows = [(r.doc_id, r.text if len(r.text or "") < 9000 else r.text[:9000]) for r in awkward.collect()]
    compare(spark, rows)
    assert suffixes.deduplicated(awkward).count() == awkward.count()
    assert suffixes.deduplicated(awkward.limit(0)).count() == 0


@pytest.mark.parametrize("part, batches", [(1000, 4), (1, 3), (2, 1), (1, 5)])
def test_passages_runs_and_overlaps(spark, part, batches):
    passage, other = prose(11, 60), prose(12, 45)
    rows = [(i, prose(100 + i, 30 + i) + passage[i % 7 :] + prose(200 + i, 20)) for i in range(12)]
    rows += [(20, "b" * 450), (21, "ab" * 300), (22, prose(5, 50) * 2), (23, passage[:199]), (24, passage[:200]), (25, other + passage), (26, passage + other), (27, passage[40:] + other)]
    compare(spark, rows, part=part, batches=batches, slot=300)


def test_the_limit_itself(spark):
    text = prose(30, 200)
    compare(spark, [(1, "x" + text[:200] + "y"), (2, "z" + text[:200] + "w"), (3, "q" + text[300:499] + "r"), (4, "s" + text[300:499] + "t")])


def test_cleaned_keeps_columns_and_whole_letters(spark, awkward):
    found = suffixes.cleaned(awkward)
    assert found.columns == awkward.columns and found.count() == awkward.count()
    df = spark.createDataFrame([(1, "é" * 150, "a"), (2, "xé" + "é" * 149, "b")], "doc_id long, text string, own string")
    rows = {r.doc_id: (r.text, r.own) for r in suffixes.cleaned(df).collect()}
    assert rows[1] == ("", "a") and rows[2] == ("x", "b")


def test_pieces_of_long_texts_hold_each_string_once():
    texts = [prose(50, 40).encode(), b"", prose(51, 400).encode(), b"x" * 100, prose(52, 30).encode()]
    blocks = list(suffixes._cut(texts, 50, size=200))
    found = Counter((i, at + p) for block in blocks for i, at, piece in block for p in range(len(piece) - 49))
    assert found == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 49))
    assert all(texts[i][at : at + len(piece)] == piece for block in blocks for i, at, piece in block)
    assert max(sum(len(x) for *_, x in block) for block in blocks) < 200 + 50


def test_passages_behind_16_mib(spark):
    passage, r = prose(60, 120), random.Random(61)
    long = [r.randbytes(8_400_000).hex(), r.randbytes(300_000).hex()]  # the passage stands behind the first 16 MiB
    at_cut = r.randbytes(524_188).hex()  # and over the end of a piece
    rows = [(1, long[0] + passage + long[1]), (2, "head " + passage + " tail"), (3, at_cut + passage + prose(62, 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: x for x in suffixes.deduplicated(df).collect()}
    spans = {i: [(x.start, x.end) for x in found[i].spans] for i in found}
    assert spans[2] == [(5, 5 + len(passage))] and bytes(found[2].left) == b"head  tail"
    assert (len(long[0]), len(long[0]) + len(passage)) in spans[1] and (len(at_cut), len(at_cut) + len(passage)) in spans[3]


def test_query(spark):
    from lumora.llm import queries
    from tests.conftest import DATA

    rows = [(r.doc_id, r.text.encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (len(t), n, k, hashlib.sha256(kept).hexdigest()) for (i, t), (kept, n, k) in zip(rows, brute([t for _, t in rows], 200), strict=True)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffixes(spark, DATA).collect()}
    assert got == want


def test_many_equal_rows(spark):
    text = random.Random(70).randbytes(1500).hex()
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text")).repartition(8)
    found = suffixes.deduplicated(rows).groupBy("n_bytes", "spans", F.length("left").alias("left")).count().collect()
    assert [(r.n_bytes, [(x.start, x.end) for x in r.spans], r.left, r["count"]) for r in found] == [(3000, [(0, 3000)], 0, 5000)]


def test_rows_are_told_apart_by_96_bits(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    rows = suffixes.identified(df, "doc_id", "text").select("uid", "also").collect()
    assert len({r.uid for r in rows}) == len({r.also for r in rows}) == 5
