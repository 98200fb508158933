import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumora.functions import metrics, text, vectors
from lumora.operators import embedding, relational, topk


def test_chunks_join_to_the_text(spark):
    @settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.too_slow])
    @given(st.lists(st.text(max_size=40), min_size=1, max_size=8), st.integers(1, 9))
    def check(texts, size):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
        got = {r.id: r.c for r in df.select("id", text.chunks(F.col("t"), size).alias("c")).collect()}
        for i, t in enumerate(texts):
            assert "".join(got[i]) == t and all(len(x) == size for x in got[i][:-1])

    check()
    assert spark.sql("select cast(null as string) t").select(text.chunks(F.col("t"), 3).alias("c")).first().c == []


def test_fitting_keeps_order_and_budget(spark):
    df = spark.createDataFrame([(1, 0, "aaaa", 1.0), (1, 1, "bbbb", 3.0), (1, 2, "cccc", 2.0), (2, 0, "x" * 400, 0.0)], "id int, position int, chunk string, s double")
    got = {r.id: r.text for r in text.fitted(text.ranked(df, "id", "s"), "id", 4).collect()}
    assert got == {1: "bbbb...cccc", 2: "x" * 400}


def test_vectors(spark):
    row = spark.sql("select array(1.0F, 2.0F) a, array(3.0F, 4.0F) b, array(0.0F, 0.0F) z")
    got = row.select(vectors.dot(F.col("a"), F.col("b")), vectors.squared_l2(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z"))).first()
    assert got[0] == 11 and got[1] == 8 and math.isclose(got[2], 11 / math.sqrt(125)) and got[3] == 0


def test_topk_small_and_clusters(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, None), (4, [9.0, 9.0])], "id int, v array<double>")
    found = topk.sem_topk(df, [0.0, 0.0], 10, vector_col="v", id_col="id", metric="l2").collect()
    assert [r.id for r in found] == [1, 2, 4, 3]
    grouped = topk.clustered(df.where("v is not null"), "v", 2)
    near = topk.routed_topk(grouped, [9.0, 9.0], 5, vector_col="v", id_col="id", cluster_col="cluster", probes=1)
    assert [r.id for r in near.collect()] == [4]


def test_metrics(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "i int"), spark.createDataFrame([(2,), (3,), (4,)], "i int")
    got = metrics.id_sets(a, b, "i").first()
    assert (got.precision, got.recall) == (0.5, 1 / 3)
    assert metrics.id_sets(a, b, "i", limit=1).first().recall == 1.0
    assert tuple(metrics.id_sets(a, b.limit(0), "i").first()) == (0.0, 0.0, 0.0)
    assert tuple(metrics.id_sets(a.limit(0), b.limit(0), "i").first())[:2] == (1.0, 1.0)
    same = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2)], "a string, b int")
    assert metrics.adjusted_rand(same, "a", "b").first().ari == 1.0 and metrics.omega(same, "a", "b").first().omega == 1.0
    errors = metrics.errors(spark.createDataFrame([(5.0, 4.0), (1.0, 0.0), (0.0, 0.0)], "g double, t double"), "g", "t").collect()
    assert [r.relative_error for r in errors] == [0.25, math.inf, 0.0]
    pairs = spark.createDataFrame([("b", "a"), ("c", "c")], "x string, y string")
    other = spark.createDataFrame([("a", "b")], "x string, y string")
    assert metrics.id_sets(metrics.tuples(pairs, ["x", "y"]), metrics.tuples(other, ["x", "y"]), "key").first().recall == 1.0


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 3, 4)], "k string, i int, v int")
    assert {r.k: r.best for r in relational.argmax(df, ["k"], "v", "i", "best").collect()} == {"a": 2, "b": 3}
    assert [r.k for r in relational.most_with_ties(df, ["k"]).collect()] == ["a"]


def test_embedding_averages_chunks_and_asks_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(len(texts))
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    df = spark.createDataFrame([(1, "aabb"), (2, "aabb"), (3, "aaaabb"), (4, ""), (5, None)], "id int, t string")
    got = {r.id: r.vector for r in embedding.embed(df, "t", model, max_chars=4).collect()}
    assert got == {1: [4.0, 2.0], 2: [4.0, 2.0], 3: [3.0, 2.0], 4: None, 5: None} and asked.value == 3


@pytest.mark.parametrize("part", [7, 40, 10**6])
def test_kendall_over_many_ranges(spark, part):
    r = random.Random(part)
    rows = [(r.randint(0, 12), r.choice([None, 0.5, 1.5, r.random()])) for _ in range(300)] + [(3, 0.5)] * 60
    pairs = [(x, y) for x, y in rows if y is not None]
    s = lambda a, b: (a > b) - (a < b)
    both = [(s(a, c), s(b, d)) for i, (a, b) in enumerate(pairs) for c, d in pairs[:i]]
    want = sum(p * q for p, q in both) / (sum(p * p for p, _ in both) * sum(q * q for _, q in both)) ** 0.5
    assert abs(metrics.kendall(spark.createDataFrame(rows, "x int, y double"), "x", "y", part=part).first().kendall - want) < 1e-12
    assert metrics.kendall(spark.createDataFrame([(1, 2.0), (1, 3.0)], "x int, y double"), "x", "y").first().kendall is None
    assert metrics.kendall(spark.createDataFrame([], "x int, y double"), "x", "y").first().kendall is None


def test_omega_with_overlap(spark):
    r = random.Random(5)
    a, b = ([(i, c) for i in range(40) for c in r.sample("pqrs", r.randint(0, 3))] + [(i, None) for i in range(40)] for _ in "ab")
    frame = lambda rows: spark.createDataFrame(rows, "i int, c string")
    of = lambda rows, i: {c for j, c in rows if j == i and c}
    both = [(len(of(a, i) & of(a, j)), len(of(b, i) & of(b, j))) for i in range(40) for j in range(i)]
    n, levels = len(both), range(5)
    seen = sum(x == y for x, y in both) / n
    chance = sum(sum(x == k for x, _ in both) * sum(y == k for _, y in both) for k in levels) / n**2
    assert abs(metrics.omega_overlap(frame(a), frame(b), "i", "c").first().omega - (seen - chance) / (1 - chance)) < 1e-12
    assert abs(metrics.omega_overlap(frame(a), frame(a), "i", "c").first().omega - 1) < 1e-12
    parts = [(i, r.choice("xyz"), r.choice("uv")) for i in range(60)]
    apart = spark.createDataFrame(parts, "i int, x string, y string")
    plain = metrics.omega(apart, "x", "y").first().omega
    assert abs(metrics.omega_overlap(apart.selectExpr("i", "x as c"), apart.selectExpr("i", "y as c"), "i", "c").first().omega - plain) < 1e-9
