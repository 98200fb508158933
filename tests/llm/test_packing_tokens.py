import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumora.llm import packing, queries, tokens
from lumora.llm.shared import new_path
from tests.conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    whole = Tokenizer.from_file(PATH)
    return [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for t in texts]


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        assert {r.padded_length for r in own} == {at if at & (at - 1) == 0 else capacity}
        padding += own[0].padded_length - at
    return padding


def test_pack_awkward(spark, awkward):
    for capacity, grain in ((1024, 16), (64, 8)):
        rows = packing.pack(awkward, tokenizer=PATH, capacity=capacity, grain=grain).collect()
        padding = check_sequences(rows, capacity)
        assert padding <= 3 * capacity + sum(r.length < grain for r in rows)
        docs = awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
        for r, ids in zip(docs, ids_of([r.text for r in docs]), strict=True):
            own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.start)
            got = b"".join(bytes(x.ids) for x in own)
            assert got == ids.tobytes() * (2 if r.doc_id == 3 else 1) if r.doc_id != 3 else len(got) == 2 * len(ids.tobytes())
            assert all(x.length * 4 == len(x.ids) and x.doc_tokens == len(ids) for x in own)
    assert packing.pack(awkward.limit(0), tokenizer=PATH).count() == 0


def test_pack_query(spark):
    rows = queries.op4_packing(spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    ids = dict(zip(docs, ids_of(docs.values()), strict=True))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total
    assert check_sequences(rows, 1024) < 3000


def test_cuts():
    for n in range(1, 5000):
        lengths = packing.cuts(n)
        assert sum(lengths) == n and all(x == 1024 or x & (x - 1) == 0 or x < 16 for x in lengths)


def test_tokens_round_trip(spark, awkward):
    path = new_path(spark, "tokens-test")
    tokens.write(awkward, path, tokenizer=PATH)
    found = tokens.read(spark, path).orderBy("start").collect()
    ids_sorted = [r.doc_id for r in found]
    assert ids_sorted == sorted(ids_sorted, key=lambda x: (x is not None, x or 0))
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.tokens)
        at += r.n_tokens
    by = {r.doc_id: r.text for r in awkward.collect()}
    for r, want in zip(found, ids_of([by[r.doc_id] for r in found]), strict=True):
        assert r.tokens == want.tolist()
    assert all(r.ids_crc32 for r in tokens.checked(tokens.read(spark, path)).collect())
    empty = new_path(spark, "tokens-empty")
    tokens.write(awkward.limit(0), empty, tokenizer=PATH)
    assert tokens.read(spark, empty).count() == 0


def test_tokens_format(spark):
    """Dictionary or delta encodings, and page indexes in each file."""
    import glob

    import pyarrow.parquet as pq

    path = new_path(spark, "tokens-format")
    tokens.write(spark.read.parquet(f"{DATA}/documents.parquet"), path, tokenizer=PATH)
    for file in glob.glob(path.removeprefix("file:") + "/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_selective_reads(spark):
    """Metadata without ids, and one document without the others: the plan reads these columns and pushes the bound down."""
    from pyspark.sql import functions as F

    path = new_path(spark, "tokens-selective")
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    tokens.write(docs.repartition(7), path, tokenizer=PATH)
    places = tokens.read(spark, path).select("doc_id", "start", "n_tokens")
    plan = places._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and places.count() == 6000
    one = tokens.read(spark, path).where("doc_id = 4321")
    assert "GreaterThan" in (text := one._jdf.queryExecution().executedPlan().toString()) or "EqualTo(doc_id,4321)" in text
    assert one.first().tokens == ids_of(["text number 4321"])[0].tolist()


def test_hot_and_special_ids(spark):
    """Many rows of one id stay together in order of the files; a special token's string has its id."""
    rows = [(7, f"row {i} <|endoftext|>") for i in range(300)] + [(None, "x"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = new_path(spark, "tokens-hot")
    tokens.write(df, path, tokenizer=PATH)
    found = tokens.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, *[7] * 300, 8]
    assert sorted(tuple(r.tokens) for r in found) == sorted(tuple(x.tolist()) for x in ids_of([t for _, t in rows]))
    assert sum(50256 in r.tokens for r in found) == 300
    packed = packing.pack(df, tokenizer=PATH).collect()
    check_sequences(packed, 1024)
    assert sum(r.length for r in packed) == sum(len(r.tokens) for r in found)


def test_token_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    at, want = 0, {}
    for i, ids in zip(sorted(docs), ids_of([docs[i] for i in sorted(docs)]), strict=True):
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_tokens(spark, DATA).collect()} == want
