import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.operators import topk, tree
from lumora.operators.embedding import embed
from lumora.operators.index import TextIndex
from lumora.operators.tree import VectorTree
from lumora.plans.judges import Judge
from lumora.sources.catalog import Catalog, fingerprint


def letters(texts):
    return [[float(t.count(c)) for c in "abcd"] for t in texts]


@pytest.mark.parametrize("cluster_col", [None, "kind"])
def test_a_changed_row_is_one_call(spark, tmp_path, cluster_col):
    asked = spark.sparkContext.accumulator(0)

    def model(texts):
        asked.add(len(texts))
        return letters(texts)

    rows = [(i, f"{'abcd'[i % 4] * (1 + i % 9)} {i}", "pq"[i % 2]) for i in range(1000)]
    frame = lambda rows: spark.createDataFrame(rows, "id long, body string, kind string")
    catalog, options = Catalog(spark, str(tmp_path / "c")), {"id_col": "id", "text_col": "body", "model": model, "cluster_col": cluster_col, "clusters": 4}
    TextIndex.get(catalog, "d", "i", frame(rows), **options)
    assert asked.value == 1000
    rows[7] = (7, "aaaaabbbbb new", "p")
    found = TextIndex.get(catalog, "d", "i", frame(rows), **options)
    assert asked.value == 1001 and found.step == 1 and found.rows.count() == 1000
    # one gone, one new with a known text, one that only moved, rows of one id, a null text
    rows = [r for r in rows if r[0] != 500] + [(2000, rows[3][1], "q"), (3, "another", "q"), (2001, None, "p"), (2002, "", "p")]
    found = TextIndex.get(catalog, "d", "i", frame(rows), **options)
    assert asked.value == 1002 and found.step == 2
    assert sorted((r.id, r.text) for r in found.rows.collect()) == sorted((i, t) for i, t, _ in rows if t)
    again = TextIndex.get(catalog, "d", "i", frame(rows), **options)
    assert again.step == 2 and asked.value == 1002
    near = {r.id for r in again.search("aaabbb", 5).collect()}
    fresh = TextIndex.build(Catalog(spark, str(tmp_path / "other")), "d", "i", frame(rows), **options)
    assert near == {r.id for r in fresh.search("aaabbb", 5).collect()}
    sizes = {r.cluster: (r.n, np.round(r.centroid, 6).tolist()) for r in again.centers.collect()}
    live: dict = {}
    for r in again.rows.collect():
        live.setdefault(r.cluster, []).append(r.vector)
    assert sizes == {c: (len(v), np.round(np.mean(v, axis=0), 6).tolist()) for c, v in live.items()}
    calls = asked.value
    many = [(i, t, k) for i, t, k in rows if i < 300]
    merged = TextIndex.get(catalog, "d", "i", frame(many), **options)  # most rows went, so the rest is written anew
    assert merged.step == 0 and merged.rows.count() == 301 and asked.value == calls


def test_fingerprints(spark):
    many = spark.range(3_000_000).selectExpr("1 AS x", "'a' AS y")
    assert fingerprint(many)[1] == 3_000_000 and fingerprint(many)[0] != fingerprint(many.limit(2_999_998))[0]
    a = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert fingerprint(a) == fingerprint(a.orderBy("y")) != fingerprint(a.union(a).union(a))
    assert fingerprint(a.limit(0))[1] == 0


def test_embedding_of_long_texts_and_clashing_names(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(len(texts))
        assert max(map(len, texts)) <= 10
        return letters(texts)

    df = spark.createDataFrame([(1, "a" * 25, 0, 0), (2, "ab", 1, 1), (3, "ab", 2, 2), (4, None, 3, 3), (5, "", 4, 4)], "id int, _text string, _one int, _piece int")
    found = {r.id: r.vector for r in embed(df, "_text", model, max_chars=10).collect()}
    assert found == {1: [25 / 3, 0, 0, 0], 2: [1, 1, 0, 0], 3: [1, 1, 0, 0], 4: None, 5: None} and calls.value == 4
    assert embed(df, "_text", model).columns == [*df.columns, "vector"]


@pytest.mark.parametrize("groups", [1, 30])
def test_tree_is_exact(spark, groups):
    r = np.random.default_rng(groups)
    centers = r.normal(size=(groups, 8))
    x = centers[r.integers(groups, size=1500)] + r.normal(size=(1500, 8)) * (0.15 if groups > 1 else 1)
    x[:40] = x[40]  # equal vectors that no split parts
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 8)], "id int, v array<double>")
    tree = VectorTree.build(df, vector_col="v", id_col="id", branching=5, leaf=30)
    leaves = tree.nodes.where("leaf")
    assert leaves.agg({"n": "sum"}).first()[0] == 1500 and tree.nodes.where("depth = 0").first().n == 1500
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (x[3], x[41] * 2, r.normal(size=8), -x[9]):
        for k in (1, 10, 100):
            found = [(y.id, round(y.score, 9)) for y in tree.search(q.tolist(), k, vector_col="v", id_col="id").collect()]
            score = unit @ (q / np.linalg.norm(q))
            want = sorted(range(1500), key=lambda i: (-round(score[i], 9), i))[:k]
            assert [s for _, s in found] == [round(score[i], 9) for i in want]
    if groups > 1:
        read = tree.leaves(x[3].tolist(), 5).agg({"n": "sum"}).first()[0]
        assert read < 0.2 * 1500
    assert tree.search([0.0] * 8, 3, vector_col="v", id_col="id").count() == 3
    assert tree.search(x[3].tolist(), 5000, vector_col="v", id_col="id").count() == 1500


def test_listwise_judge(spark):
    calls = spark.sparkContext.accumulator(0)
    rows = [(i, f"{(i * 37) % 101:03d}" if i % 9 else None, -float(i)) for i in range(95)]
    df = spark.createDataFrame(rows, "id int, text string, score double").repartition(4)

    def model(prompts):
        calls.add(len(prompts))
        lists = [json.loads(p.split("\n", 1)[1])["records"] for p in prompts]
        assert max(map(len, lists)) <= 10
        return [json.dumps(sorted((i for i, t in enumerate(x) if t), key=lambda i: x[i], reverse=True)) for x in lists]

    found = topk.judged_topk(df, "Largest first.", 4, Judge(model=model), text_col="text", id_col="id", size=10, errors="why").collect()
    best = sorted((r for r in rows if r[1]), key=lambda r: r[1], reverse=True)[:4]
    assert [(r.id, r["rank"], r.why) for r in found] == [(x[0], i + 1, None) for i, x in enumerate(best)]
    assert calls.value <= 10 + 4 + 2 + 1
    silent = topk.judged_topk(df, "x", 4, Judge(model=lambda p: ["no"] * len(p)), text_col="text", id_col="id", size=10, errors="why").collect()
    assert [r.id for r in silent] == [0, 1, 2, 3] and "JSON list of places" in silent[0].why
    assert topk.judged_topk(df.limit(0), "x", 4, Judge(model=model), text_col="text", id_col="id").count() == 0
    with pytest.raises(ValueError):
        topk.judged_topk(df, "x", 6, Judge(model=model), text_col="text", id_col="id", size=10)
    assert topk.parse_ranking("so: [2, 0, 2]") == "[2, 0]" and topk.parse_ranking("[a]") is None and topk.parse_ranking("[-1]") is None


def test_tree_deals_the_rows_of_one_node(spark, monkeypatch):
    """The root's rows meet its centers in several tasks, by number or by node; the answers are the exact ones."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 4))
    x[200:450] = x[0]  # a group that does not part
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").coalesce(1)
    rows = df.select("id", F.col("v").alias("_unit"), F.lit("0").alias("node"))
    table = spark.createDataFrame([("0", 1)], "node string, c int")
    monkeypatch.setattr(tree, "SIDE", 8)
    met = tree._met(rows, table, "node", False)
    assert met.count() == 700 and met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400
    monkeypatch.setattr(tree, "HELD", 0)
    made = VectorTree.build(df, vector_col="v", id_col="id", branching=3, leaf=40)
    assert made.rows.count() == 700 and made.nodes.where("leaf").agg(F.sum("n")).first()[0] == 700
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (x[0], x[5]):
        scores = np.round(unit @ q / np.linalg.norm(q), 9)
        wanted = sorted(range(700), key=lambda i: (-scores[i], i))[:7]
        assert [r.id for r in made.search(q.tolist(), 7, vector_col="v", id_col="id").withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "id").collect()] == wanted
