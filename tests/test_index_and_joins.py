import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumora.functions import metrics, text
from lumora.operators import joins, relational
from lumora.operators.index import TextIndex, summaries
from lumora.sources.catalog import Catalog


def letters(texts):
    return [[float(t.count(c)) for c in "abc"] for t in texts]


def test_index_is_built_once_and_again_when_stale(spark, tmp_path):
    built = spark.sparkContext.accumulator(0)

    def model(texts):
        built.add(len(texts))
        return letters(texts)

    docs = spark.createDataFrame([(i, c * (1 + i % 5) + "d") for i, c in enumerate("abc" * 20)] + [(60, None), (61, "")], "id int, body string")
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    options = {"id_col": "id", "text_col": "body", "model": model, "clusters": 3}
    first = TextIndex.get(catalog, "d", "letters", docs, **options)
    calls = built.value
    assert calls == 15  # distinct texts
    again = TextIndex.get(catalog, "d", "letters", docs, **options)
    assert built.value == calls and again.rows.count() == first.rows.count() == 60
    assert again.search("bbb", 1000).count() == 60
    near = again.search("bbb", 30, probes=1)
    assert near.count() == 20 and all("b" in r.body for r in near.withColumnRenamed("text", "body").collect())
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cluster" in plan.replace("isnotnull(cluster#", "cluster#") or "PartitionFilters: [isnotnull" in plan
    fewer = TextIndex.get(catalog, "d", "letters", docs.where("id < 30"), **options)
    assert built.value == calls + 2 and fewer.rows.count() == 30  # other rows of known texts; the calls were the two queries
    calls = built.value
    catalog.mark_stale("index", "d", "letters")
    TextIndex.get(catalog, "d", "letters", docs.where("id < 30"), **options)
    assert built.value > calls


def test_summaries_are_cached_by_content(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(len(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [t[:3].upper() for t in texts]

    cache = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, ""), (4, None)], "id int, t string")
    for _ in range(2):
        assert {r.id: r.summary for r in summaries(df, "t", model, cache=cache).collect()} == {1: "ONE", 2: "ONE", 3: None, 4: None}
    assert asked.value == 1
    more = df.union(spark.createDataFrame([(5, "bad" * 400)], df.schema)).coalesce(1)
    kept = {r.id: (r.summary, r.why) for r in summaries(more, "t", model, cache=cache, batch=1, errors="why").collect()}
    assert kept[5] == (("bad" * 400)[:500], "RuntimeError: no answer") and kept[1] == ("ONE", None)
    calls = asked.value
    summaries(more, "t", model, cache=cache, batch=1).count()
    assert asked.value == calls + 1  # what failed is asked again


def test_summaries_cover_whole_texts(spark):
    """A text of many chunks is summarised in rounds; its last word is in the summary."""
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        assert max(map(len, texts)) <= 100
        return [" ".join(w for w in t.split() if w.isupper())[:40] or "-" for t in texts]

    text = "FIRST " + "x y z " * 200 + "MIDDLE " + "x y z " * 200 + "LAST"
    df = spark.createDataFrame([(1, text), (2, "SHORT one")], "id int, _text string")
    found = {r.id: r.summary for r in summaries(df, "_text", model, chars=100).collect()}
    assert found[2] == "SHORT" and all(w in found[1] for w in ("FIRST", "MIDDLE", "LAST"))
    echo = summaries(df, "_text", lambda t: [x + "!" for x in t], chars=100, errors="why").where("id = 1").first()
    assert "no shorter" in echo.why and echo.summary == text[:500]


@pytest.mark.parametrize("threshold", [0.9, 0.3, -0.5])
def test_embedding_join_loses_no_pair(spark, threshold):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(60, 6)), r.normal(size=(80, 6))
    b[:20] = a[:20] + r.normal(size=(20, 6)) * 0.2
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(90, None), (91, [0.0] * 6), (92, [1.0])], "l int, u array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)] + [(90, [float("nan")] * 6)], "r int, v array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(unit(a) @ unit(b).T >= threshold)), strict=True))
    assert {(x.l, x.r) for x in joins.embedding_join(left, right, "u", "v", threshold, pivots=10).collect()} == want
    assert joins.embedding_join(left, right.limit(0), "u", "v", threshold).count() == 0


def test_embedding_join_of_two_lengths_and_a_hot_cell(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=(40, 5)), np.concatenate([np.tile(r.normal(size=(1, 5)), (60, 1)), r.normal(size=(40, 5))])
    c = r.normal(size=(30, 3))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*a, *c[:20]])], "_cell int, u array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*b, *c[10:]])], "_split int, v array<float>")
    cos = lambda x, y: len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    x, y = [*a, *c[:20]], [v.astype(np.float32).astype(float) for v in (*b, *c[10:])]
    want = {(i, j) for i, p in enumerate(x) for j, q in enumerate(y) if cos(p, q) is not False and cos(p, q) >= 0.6}
    found = [(z._cell, z._split) for z in joins.embedding_join(left, right, "u", "v", 0.6, pivots=6, part=7).collect()]
    assert set(found) == want and len(found) == len(want)


def test_embedding_join_where_pivots_are_of_no_use(spark):
    """Vectors without groups at a low threshold: all pairs are compared, as products of matrices."""
    r = np.random.default_rng(8)
    a, b = (r.normal(size=(3000, 64)).astype(np.float32).astype(float) for _ in range(2))
    left = spark.createDataFrame(pd.DataFrame({"l": range(3000), "u": list(a)}), "l int, u array<float>")
    right = spark.createDataFrame(pd.DataFrame({"r": range(3000), "v": list(b)}), "r int, v array<float>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = unit(a) @ unit(b).T
    began = time.monotonic()
    found = joins.embedding_join(left, right, "u", "v", 0.3, vectors=False).toPandas()
    assert time.monotonic() - began < 60
    assert list(found.columns) == ["l", "r", "score"] and len(found) == (want >= 0.3).sum() > 10_000
    assert np.abs(want[found.l, found.r] - found.score).max() < 1e-12 and not found.duplicated(["l", "r"]).any()


def test_embedding_join_of_huge_and_tiny_numbers(spark):
    left = spark.createDataFrame([(1, [3e200, 4e200]), (2, [3e-200, 4e-200]), (3, [1.0, -1.0])], "l int, u array<double>")
    right = spark.createDataFrame([(1, [3.0, 4.0]), (2, [4e200, 3e200]), (3, [-3.0, -4.0])], "r int, v array<double>")
    found = {(x.l, x.r): x.score for x in joins.embedding_join(left, right, "u", "v", 0.95).collect()}
    assert found == pytest.approx({(1, 1): 1.0, (1, 2): 0.96, (2, 1): 1.0, (2, 2): 0.96})


@pytest.mark.parametrize("on", [["k"], []])
def test_asof_join_of_a_hot_key(spark, on):
    r = random.Random(6)
    left = [("hot" if r.random() < 0.9 else r.choice(["a", None]), r.choice([None, *range(300)]), i) for i in range(400)]
    right = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), r.choice([None, *range(0, 300, 37)]), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        found = {z.i: z.last for z in relational.asof_join(a, b.select(*on, "t", "v"), on, "t", "v", "last").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, t, i in left:
        rows = [(s, v) for q, s, v in right if s is not None and t is not None and s <= t and (not on or q == k)]
        assert found[i] == (max(rows)[1] if rows else None)


def test_not_in_as_sql_has_it(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    for values, want in (([1], {2}), ([1, None], set()), ([], {1, 2, None})):
        of = spark.createDataFrame([(v,) for v in values], "v int")
        df.createOrReplaceTempView("not_in_rows")
        of.createOrReplaceTempView("not_in_values")
        found = {r.x for r in relational.not_in(df, "x", of, "v").collect()}
        assert found == want == {r.x for r in spark.sql("SELECT x FROM not_in_rows WHERE x NOT IN (SELECT v FROM not_in_values)").collect()}


def test_range_interval_and_asof_joins(spark):
    r = random.Random(4)
    points = [(i, r.uniform(-20, 20)) for i in range(80)] + [(99, None)]
    spans = [(i, a, a + r.choice([0.0, 0.5, 3.0, 17.0])) for i, a in enumerate(r.uniform(-20, 20) for _ in range(40))] + [(77, None, 1.0)]
    p = spark.createDataFrame(points, "p int, x double")
    s = spark.createDataFrame(spans, "s int, a double, b double")
    want = {(i, j) for i, x in points for j, a, b in spans if x is not None and a is not None and a <= x < b}
    found = [(x.p, x.s) for x in relational.range_join(p, s, "x", "a", "b", 2.5).collect()]
    assert set(found) == want and len(found) == len(want)
    t = s.select(F.col("s").alias("t"), F.col("a").alias("c"), F.col("b").alias("d"))
    want = {(i, j) for i, a, b in spans for j, c, d in spans if a is not None and c is not None and a < b and c < d and a < d and c < b}
    found = [(x.s, x.t) for x in relational.interval_join(s, t, ("a", "b"), ("c", "d"), 2.5).collect()]
    assert set(found) == want and len(found) == len(want)
    clash = s.withColumnRenamed("s", "_slot")
    assert relational.range_join(p, clash, "x", "a", "b", 2.5).select("p", "_slot").count() == relational.range_join(p, s, "x", "a", "b", 2.5).count()
    assert relational.interval_join(clash, t, ("a", "b"), ("c", "d"), 2.5).select("_slot").count() == len(want)
    left = spark.createDataFrame([("k", 1, "a"), ("k", 5, "b"), ("m", 5, "c"), (None, 5, "d"), ("k", None, "e")], "k string, t int, name string")
    right = spark.createDataFrame([("k", 1, 10), ("k", 4, 40), ("k", 4, 41), ("k", 6, 60), ("m", 6, 99), (None, 1, 7), ("k", None, 8)], "k string, t int, v int")
    assert {x.name: x.last for x in relational.asof_join(left, right, ["k"], "t", "v", "last").collect()} == {"a": 10, "b": 41, "c": None, "d": 7, "e": None}


def test_fitting_of_records(spark):
    df = spark.createDataFrame([(1, "aaaabbbb", "ccccddddeeee"), (2, "aaaa", None), (3, None, "x" * 400), (4, "", "y" * 400)], "id int, a string, b string")
    got = {r.id: (r.a, r.b) for r in text.fit_record(df, ["a", "b"], 6, chars=4).collect()}
    assert got[1] == ("aaaa...bbbb", "cccc")  # in turns, two tokens each
    assert got[2] == ("aaaa", None) and got[3] == (None, "xxxx...xxxx...xxxx") and got[4] == ("", "yyyy...yyyy...yyyy")
    best = text.fit_record(df, ["a", "b"], 4, chars=4, score=lambda c: F.when(c == "bbbb", 2).when(c == "eeee", 1).otherwise(0)).where("id = 1").first()
    assert (best.a, best.b) == ("bbbb", "eeee")
    left, right = text.fit_join(df, df, ["a"], ["b"], 4, chars=4)
    assert left.where("id = 1").first().a == "aaaa" and right.where("id = 1").first().b == "cccc"
    assert {r.id: (r.a, r.b) for r in text.fit_aggregate(df, ["a", "b"], 10_000).collect()} == {r.id: (r.a, r.b) for r in df.collect()}
    small = {r.id: len(r.b or "") for r in text.fit_aggregate(df, ["a", "b"], 50, chars=4).collect()}
    assert 0 < small[3] < 400 and text.chunk_record(df, ["a"], 4).where("id = 1").first().a == ["aaaa", "bbbb"]


def test_metrics_with_nulls_and_by_name(spark):
    df = spark.createDataFrame([(None, None), ("a", "a"), ("a", None)], "t string, g string")
    assert abs(metrics.metric("macro_f1", df, "t", "g").first().macro_f1 - 2 / 3) < 1e-9
    rows = metrics.matched_rows(df.select("t", "g"), spark.createDataFrame([(None, None), ("a", "a"), ("a", "a")], "t string, g string")).first()
    assert (rows.precision, rows.recall) == (2 / 3, 2 / 3)
    numbers = spark.createDataFrame([(float(i % 7), float((i * 5) % 11)) for i in range(50)] + [(None, 1.0)], "x double, y double")
    import pandas as pd

    ranks = pd.DataFrame([(i % 7, (i * 5) % 11) for i in range(50)]).rank()
    want = ranks[0].corr(ranks[1])
    assert abs(metrics.spearman(numbers, "x", "y").first().spearman - want) < 1e-9


def test_ranks_of_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", 2.0), ("e", None)], "k string, v double")
    assert {r.k: r.place for r in relational.ranked_means(df, "k", F.col("v")).collect()} == {"b": 1, "c": 1, "d": 3, "a": 4, "e": 5}


def test_scalar_functions_by_code(spark):
    """One of each category of scalar functions that a code step may call."""
    from lumora.frame import SemFrame

    frame = SemFrame(spark.createDataFrame([(7, -2.5, "b,a,c", "2024-02-29")], "i int, x double, s string, d string"))
    row = frame.code(
        "SELECT round(sqrt(i), 3) root, abs(x) a, floor(x / 2) f, try_cast('z' AS int) t, array_sort(split(s, ',')) parts, upper(s) u, ascii(s) o, "
        "i & 3 bits, i IN (1, 7) has, x <=> NULL same, date_trunc('month', to_timestamp(d)) m, aggregate(array(1, 2, 3), 0, (p, q) -> p + q) total, regexp_extract(s, '([a-c]),a', 1) g FROM {rows}"
    ).df.first()
    assert (row.root, row.a, row.f, row.t, row.parts, row.u, row.o, row.bits, row.has, row.same, row.total, row.g) == (2.646, 2.5, -2, None, ["a", "b", "c"], "B,A,C", 98, 3, True, False, 6, "b")
    assert row.m.day == 1
