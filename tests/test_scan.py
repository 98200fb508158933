import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lumora import queries
from lumora.functions import variants
from lumora.operators import sketches, table_functions
from lumora.plans.judges import Field, Judge, Unanswered
from lumora.sources import scan
from tests.conftest import DATA


@pytest.fixture
def folder(tmp_path):
    lines = [f"{i} " + "é" * (i % 50) for i in range(3000)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "long.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "sub" / "unended.log").write_text("a\n\nb")
    (tmp_path / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "_hidden.txt").write_text("x")
    (tmp_path / "plain").write_bytes(b"x\xff")
    return tmp_path, lines


def test_scan_by_ranges(spark, folder):
    path, lines = folder
    rows = scan.scan(spark, str(path), rangeBytes="1000", partitionBytes="7000").collect()
    names = {os.path.relpath(r.uri, path) for r in rows}
    assert names == {"sub/long.txt", "sub/unended.log", "bad.docx", "empty.txt", "plain"}
    own = sorted((r for r in rows if r.suffix == "txt" and r.size), key=lambda r: r.start)
    assert len(own) == -(-own[0].size // 1000) and "".join(r.contents for r in own) == "\n".join(lines) + "\n"
    by = {os.path.relpath(r.uri, path): r for r in rows}
    assert by["bad.docx"].contents is None and "BadZipFile" in by["bad.docx"].error
    assert by["empty.txt"].contents == "" and by["plain"].contents == "x�" and by["sub/unended.log"].contents == "a\n\nb"


def test_options_choose_files_before_they_are_opened(spark, folder):
    path, _ = folder
    parts = lambda **options: scan.DocumentReader({"path": str(path), "partitionBytes": "1", **options}).partitions()
    names = lambda **options: sorted({os.path.relpath(x.uri, path) for p in parts(**options) for x in p.pieces})
    assert len(parts()) == 5 and scan.scan(spark, str(path), partitionBytes="1").rdd.getNumPartitions() == 5
    assert names(suffixes="LOG, docx") == ["bad.docx", "sub/unended.log"] and names(under="sub/l") == ["sub/long.txt"]
    assert names(smallest="3", largest="20") == ["bad.docx", "sub/unended.log"] and names(suffixes="pdf") == []
    assert names(after="2100-01-01") == [] and len(names(before="2100-01-01T00:00:00", after="2001-01-01")) == 5
    assert parts(suffixes="pdf") == [scan.Part(())]
    files = scan.scan(spark, str(path))  # filters of one query leave the next alone
    assert (files.where("suffix = 'log'").count(), files.count(), files.where("suffix = 'txt'").count()) == (1, 5, 2)
    assert [r.contents for r in scan.scan(spark, str(path), suffixes="log").collect()] == ["a\n\nb"]
    size = {r.suffix: (r.files, r.bytes, r.tokens) for r in scan.statistics(spark, str(path)).collect()}
    assert size["docx"] == (1, 10, 3) and size["log"] == (1, 4, 2)


def test_chunks_in_sql(spark):
    table_functions.register_chunks(spark, "pieces")
    df = spark.createDataFrame([(1, "abcde"), (2, ""), (3, None), (4, "xy")], "id int, t string")
    found = spark.sql("SELECT id, position, chunk FROM {df}, LATERAL pieces(t, 2)", df=df)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, "ab"), (1, 1, "cd"), (1, 2, "e"), (4, 0, "xy")]


def test_a_model_in_sql(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return ["?" if "bad" in p else '[{"w": "a", "n": 1}, {"w": 2}, 7]' if "two" in p else "[]" for p in prompts]

    table_functions.register_flat_map(spark, "found", Judge(model=model, attempts=2), [Field("w"), Field("n")], "t")
    df = spark.createDataFrame([(1, "two"), (2, "none"), (3, "bad"), (4, "two"), (None, "two")], "id int, t string").coalesce(1)
    rows = sorted((tuple(r) for r in spark.sql("SELECT * FROM found(TABLE(SELECT id, t FROM {df}))", df=df).collect()), key=repr)
    good = [("a", "1", None), ("2", None, None), (None, None, None)]
    assert [r[:3] for r in rows if r[3]] == [("3", None, None)] and "no reply" in [r[3] for r in rows if r[3]][0]
    assert sorted((r for r in rows if not r[3]), key=repr) == sorted([(k, *g) for k in ("1", "4", None) for g in good], key=repr)
    assert asked.value == 3 + 1  # equal records once, the bad one again
    with pytest.raises(Unanswered):
        table_functions.register_flat_map(spark, "x", Judge(), [Field("w")], "t")


def test_sketches_merge(spark):
    df = spark.range(200_000).selectExpr("id % 10 AS day", "id % 50000 AS user", "double(id) AS v").union(spark.createDataFrame([(3, None, None)], "day long, user long, v double"))
    days = sketches.sketched(df, ["day"], "user", "v")
    whole = sketches.estimates(sketches.merged(days.where("day < 10"), []), (0.25, 0.5)).first()
    assert whole.n == 200_001
    assert abs(whole.distinct_hll / 50_000 - 1) < 0.06 and abs(whole.distinct_theta / 50_000 - 1) < 0.06
    assert abs(whole.quantiles[0] / 200_000 - 0.25) < 0.03 and abs(whole.quantiles[1] / 200_000 - 0.5) < 0.03
    a, b = (days.where(f"day = {d}").select("theta").first()[0] for d in (0, 1))
    both = spark.createDataFrame([(a, b)], "a binary, b binary")
    assert both.select(sketches.common(both.a, both.b)).first()[0] == 0  # users of different days differ


def test_one_language_is_written_by_all_tasks(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{DATA}/documents.parquet").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "new_path", lambda spark, what: f"{tmp_path}/{what}")
    found = queries.QUERIES["scan_documents"](spark, str(tmp_path))
    assert found.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DATA}/documents.parquet").where("lang <> 'en'").count()
    assert len(list((tmp_path / "files" / "lang=en").glob("*.json"))) > 1


def test_counts_of_parts_are_exact(spark):
    df = spark.range(60_000).selectExpr("id % 10 AS day", "id % 15000 AS user").union(spark.createDataFrame([(3, None), (77, None)], "day long, user long"))
    parts = sketches.parted(df, ["day"], "user")
    assert [r.distinct_values for r in sketches.counts(parts, []).collect()] == [15_000]
    assert {r.day: r.distinct_values for r in sketches.counts(parts, ["day"]).collect()} == {d: 1500 for d in range(10)}
    assert sketches.parted(df.where("user is null"), ["day"], "user").isEmpty()


def test_merged_users_beyond_a_sketch(spark, same, tmp_path):
    spark.range(12_000).selectExpr("id % 6000 AS user_id", "double(id) AS value", "timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 30)) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    same(queries.QUERIES["approx_merged"](spark, str(tmp_path)), duck.sql(queries.ORACLE_SQL["approx_merged"]))


def test_variants(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 5}], "c": "x"}'), (2, '{"a": [], "c": 2.5}'), (3, "no json"), (4, None)], "id int, j string")
    found = variants.facts(variants.parsed(df, "j"), "variant", {"b": ("$.a[0].b", "int"), "c": ("$.c", "double")})
    assert {r.id: (r.b, r.c) for r in found.select("id", "b", "c").collect()} == {1: (5, None), 2: (None, 2.5), 3: (None, None), 4: (None, None)}
    assert variants.shape(found.where("id < 3"), "variant").first()["shape"].startswith("OBJECT<a: ARRAY")
    with pytest.raises(Exception, match="JSON|MALFORMED"):
        variants.parsed(df, "j", strict=True).selectExpr("to_json(variant)").collect()
