import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumora.frame import SemFrame
from lumora.operators import relational, semantic
from lumora.plans import fitting
from lumora.plans.fitting import Fitter
from lumora.plans.judges import Field, Judge, Pairs, Unanswered, parse_boolean, parse_json

ANIMALS = [("giraffe", 1000), ("elephant", 6200), ("snake", 50), ("salmon", 5), ("eagle", 4)]
KINDS = {"giraffe": "mammal", "elephant": "mammal", "snake": "reptile", "salmon": "fish", "eagle": "bird"}


def _record(prompt):
    return json.loads(prompt.split("\n", 1)[1])


@pytest.fixture
def animals(spark):
    return spark.createDataFrame(ANIMALS, "animal string, weight long")


def is_mammal(prompts):
    return [f"```text\n{str(KINDS.get(_record(p)['animal']) == 'mammal').upper()}\n```" for p in prompts]


def test_filter_by_model_asks_equal_rows_once(spark, animals):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return is_mammal(prompts)

    df = animals.unionByName(animals).unionByName(spark.createDataFrame([(None, 1)], animals.schema))
    found = semantic.sem_filter(df, "It is a mammal.", Judge(model=model), columns=["animal"])
    assert sorted(r.animal for r in found.collect()) == ["elephant", "elephant", "giraffe", "giraffe"]
    assert found.columns == df.columns
    assert asked.value == 6


def test_unparseable_rows_drop_or_fail(spark, animals):
    def silent(prompts):
        return ["true or false"] * len(prompts)

    assert semantic.sem_filter(animals, "x", Judge(model=silent)).count() == 0
    with pytest.raises(Exception, match="no reply to be parsed"):
        semantic.sem_filter(animals, "x", Judge(model=silent, fail_fast=True)).count()


def test_only_open_rows_are_asked_again(spark, animals):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return ["?" if _record(p)["animal"] == "snake" else "true" for p in prompts]

    assert semantic.sem_filter(animals.coalesce(1), "x", Judge(model=model, attempts=3)).count() == 4
    assert asked.value == 5 + 2


def test_map_types_missing_and_overwrite(spark, animals):
    def model(prompts):
        return [json.dumps({"weight": "12", "kind": KINDS[_record(p)["animal"]]} if _record(p)["animal"] != "eagle" else {}) for p in prompts]

    found = semantic.sem_map(animals, [Field("weight", "double"), Field("kind")], Judge(model=model))
    rows = {r.animal: (r.weight, r.kind) for r in found.collect()}
    assert rows["eagle"] == (None, None) and rows["snake"] == (12.0, "reptile")
    assert found.columns == ["animal", "weight", "kind"]


def test_flat_map(spark):
    df = spark.createDataFrame([("apple red, pear green", 1), ("", 2), (None, 3)], "text string, n int")

    def model(prompts):
        return [json.dumps([dict(zip(("fruit", "color"), x.split(), strict=False)) for x in (_record(p)["text"] or "").split(", ") if x]) for p in prompts]

    found = semantic.sem_flat_map(df, [Field("fruit"), Field("color")], Judge(model=model), "the fruits")
    assert sorted((r.n, r.fruit, r.color) for r in found.select("n", "fruit", "color").collect()) == [(1, "apple", "red"), (1, "pear", "green")]
    assert semantic.sem_flat_map(df.limit(0), [Field("fruit")], Judge(model=model), "x").count() == 0


def test_join_prefixes_and_blocks(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "k int, x string, own int")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (2, "r"), (None, "s")], "k int, x string")
    rule = Judge(rules={"same": lambda: Pairs((("k", "k"),), lambda a, b: b("x") > "p")})
    found = semantic.sem_join(left, right, "same", rule)
    assert found.columns == ["left_k", "left_x", "own", "right_k", "right_x"]
    assert sorted((r.left_x, r.right_x) for r in found.collect()) == [("a", "q"), ("b", "r")]

    def model(prompts):
        return [str(_record(p)["right_x"] != "q") for p in prompts]

    judged = semantic.sem_join(left, right, "fits", Judge(model=model), on=[("k", "k")])
    assert sorted((r.left_x, r.right_x) for r in judged.collect()) == [("a", "p"), ("b", "r")]
    with pytest.raises(Unanswered):
        semantic.sem_join(left, right, "fits", Judge(model=model))


def test_join_of_hot_keys_is_dealt_by_pairs(spark):
    left = spark.range(2003).selectExpr("IF(id < 1900, 1, IF(id < 2000, id % 7, NULL)) AS k", "id AS x").withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    right = spark.range(307).selectExpr("IF(id < 280, 1, IF(id < 305, id % 9, NULL)) AS k", "id AS y")
    wanted = left.alias("l").join(right.alias("r"), F.expr("l.k = r.k AND y % 3 < x % 3")).selectExpr("l.k", "x", "y")
    found = relational.cell_join(left.withColumnRenamed("k", "a"), right.withColumnRenamed("k", "b"), [("a", "b")], F.expr("y % 3 < x % 3"), side=100)
    assert found.columns == ["a", "x", "m", "b", "y"]
    assert sorted(found.select("a", "x", "y").collect()) == sorted(wanted.collect())
    most = found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 0.3 * found.count()  # nine of ten pairs have one key
    assert relational.cell_join(left.limit(0).withColumnRenamed("k", "a"), right, [("a", "k")]).isEmpty()


def test_files_of_joined_pairs_are_small(spark, tmp_path):
    """Pairs of many rows of a key that a comparison chooses: partners repeat in order, so that a pair takes little over a byte at most."""
    rule = Judge(rules={"less": lambda: Pairs((("k", "k"),), lambda a, b: b("x") > a("x"))})
    rows = lambda name: spark.range(4200).select(F.lit(1).alias("k"), F.col("id").alias(name), F.round(F.rand(len(name)) * 10_000, 2).alias("x"))
    left, right = rows("one"), rows("other")
    place = str(tmp_path / "pairs")
    semantic.sem_join(left, right, "less", rule).write.parquet(place)
    pairs = spark.read.parquet(place)
    a, b = ([r.x for r in df.collect()] for df in (left, right))
    assert pairs.count() == sum(y > x for x in a for y in b)
    assert pairs.where("right_x > left_x").select("one", "other").distinct().count() == pairs.count()
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1.2 * pairs.count()


def test_aggregate_in_packs(spark, animals):
    def model(prompts):
        out = []
        for p in prompts:
            records = [json.loads(x) for x in json.loads(_record(p)["records"])]
            out.append(json.dumps({"total": sum(r.get("weight", r.get("total", 0)) or 0 for r in records)}))
        return out

    for budget in (5, 10_000):
        found = semantic.sem_aggregate(animals.repartition(3), "Add the weights.", [Field("total", "bigint")], Judge(model=model), budget=max(budget, 40))
        assert [r.total for r in found.collect()] == [7259]


def _adder(spoiled=None):
    """Adds weights; has no answer to a pack that holds `spoiled`."""

    def model(prompts):
        out = []
        for p in prompts:
            records = json.loads(_record(p)["records"])
            total = sum(json.loads(x).get("weight", json.loads(x).get("total", 0)) for x in records)
            out.append("none" if any(json.loads(x).get("weight") == spoiled for x in records) and spoiled else json.dumps({"total": total}))
        return out

    return model


def test_an_unanswered_pack_leaves_no_partial_answer(spark):
    rows = [(k, 100_000 + i) for k in ("a", "b") for i in range(60)] + [("b", 7)]
    df = spark.createDataFrame(rows, "k string, weight long")
    fields = [Field("total", "bigint")]
    fine = semantic.sem_aggregate(df, "Add.", fields, Judge(model=_adder()), budget=80).collect()
    assert [r.total for r in fine] == [sum(w for _, w in rows)]
    assert [r.total for r in semantic.sem_aggregate(df, "Add.", fields, Judge(model=_adder(7)), budget=80).collect()] == [None]
    found = {r.k0: (r.v0, r.error is None) for r in semantic._reduced(df, ["k"], "Add.", fields, Judge(model=_adder(7)), 80)[0].collect()}
    assert found == {"a": (sum(w for k, w in rows if k == "a"), True), "b": (None, False)}


def test_equal_records_spread_over_packs(spark):
    df = spark.createDataFrame([(5,)] * 500 + [(i,) for i in range(1000, 1040)], "weight long")

    def model(prompts):
        for p in prompts:
            assert len(json.loads(_record(p)["records"])) < 120, "a pack far over its budget"
        return _adder()(prompts)

    found = semantic.sem_aggregate(df, "Add.", [Field("total", "bigint")], Judge(model=model), budget=400).collect()
    assert [r.total for r in found] == [2500 + sum(range(1000, 1040))]


def test_groupby_builtin_and_null_keys(spark):
    df = spark.createDataFrame([("a", 1.5), ("a", None), (None, None), ("b", None)], "k string, v double")
    rows = {r.k: r for r in semantic.sem_groupby(df, [Field("k")], [("v", "count", "n"), ("v", "sum", "s"), ("v", "mean", "m"), ("v", "min"), ("v", "max")], Judge()).collect()}
    assert (rows["a"].n, rows["a"].s, rows["a"].m, rows["a"].v) == (2, 1.5, 1.5, 1.5)
    assert (rows["b"].n, rows["b"].s, rows["b"].m) == (1, 0.0, None)
    assert rows[None].n == 1 and rows[None].s == 0.0


def test_groupby_derived_key_and_model_aggregate(spark, animals):
    def model(prompts):
        out = []
        for p in prompts:
            r = _record(p)
            if "records" in r:
                out.append(json.dumps({"names": str(len(json.loads(r["records"])))}))
            else:
                out.append(json.dumps({"kind": KINDS[r["animal"]]}))
        return out

    found = semantic.sem_groupby(animals, [Field("kind")], [("weight", "sum", "total"), ("animal", "list the animals", "names")], Judge(model=model))
    rows = {r.kind: (r.total, r.names) for r in found.collect()}
    assert rows == {"mammal": (7200.0, "2"), "reptile": (50.0, "1"), "fish": (5.0, "1"), "bird": (4.0, "1")}


def test_a_prompt_is_asked_once_over_a_whole_query(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return [json.dumps({"n": str(len(json.loads(r["records"])))} if "records" in (r := _record(p)) else {"kind": r["x"] % 3}) for p in prompts]

    df = spark.createDataFrame([(i, i) for i in range(60)], "x long, y long")
    judge = Judge(model=model)
    found = semantic.sem_groupby(df, [Field("kind", "bigint")], [("y", "sum", "total"), ("y", "how many", "n")], judge)
    assert sorted((r.kind, r.n) for r in found.collect()) == [(k, "20") for k in range(3)]
    assert found.count() == 3 and asked.value == 63  # n for the keys and one a group
    semantic.sem_map(df, [Field("kind", "bigint")], judge).count()
    assert asked.value == 63  # the same prompts as for the keys
    judge.forget()
    semantic.sem_map(df, [Field("kind", "bigint")], judge).count()
    assert asked.value == 123


def test_rounds_of_packs_are_asked_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return _adder()(prompts)

    df = spark.createDataFrame([(100_000 + i,) for i in range(200)], "weight long")
    assert semantic.sem_aggregate(df, "Add.", [Field("total", "bigint")], Judge(model=model), budget=200).first().total == sum(range(100_000, 100_200))
    first = -(-200 * 6 // 200)
    assert first <= asked.value <= 2 * first + 2


def test_errors_are_kept(spark, animals):
    def model(prompts):
        return ["?" if _record(p).get("animal") == "eagle" else '{"kind": "x"}' if "object" in p else "true" for p in prompts]

    judge = Judge(model=model)
    kept = {r.animal: r.why for r in semantic.sem_filter(animals, "c", judge, errors="why").collect()}
    assert len(kept) == 5 and "no reply" in kept["eagle"] and kept["snake"] is None
    mapped = {r.animal: (r.kind, r.why is None) for r in semantic.sem_map(animals, [Field("kind")], judge, errors="why").collect()}
    assert mapped["eagle"] == (None, False) and mapped["snake"] == ("x", True)
    flat = semantic.sem_flat_map(animals, [Field("kind")], judge, "t. A JSON object", errors="why")
    assert flat.columns == ["animal", "weight", "why", "kind"] and {r.animal: (r.kind, r.why is None) for r in flat.collect()}["eagle"] == (None, False)
    silent = semantic.sem_aggregate(animals, "t", [Field("error")], Judge(model=lambda p: ["?"] * len(p)), errors="why").collect()
    assert [(r.error, "no reply" in r.why) for r in silent] == [(None, True)]
    native = Judge(rules={"c": lambda d: F.lit(True)})
    assert {r.why for r in semantic.sem_filter(animals, "c", native, errors="why").collect()} == {None}


def test_aggregate_of_nothing_is_one_row(spark, animals):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return [json.dumps({"total": len(json.loads(_record(p)["records"]))}) for p in prompts]

    assert [r.total for r in semantic.sem_aggregate(animals.limit(0), "t", [Field("total", "bigint")], Judge(model=model)).collect()] == [0]
    assert asked.value == 1


def test_flat_map_casts_each_field(spark):
    df = spark.createDataFrame([("a",)], "x string")
    model = lambda prompts: [json.dumps([{"f": "12"}, {"f": "x"}, {"f": 3, "g": [1]}, {}])] * len(prompts)
    found = semantic.sem_flat_map(df, [Field("f", "bigint"), Field("g", "array<int>")], Judge(model=model), "t").collect()
    assert [(r.f, r.g) for r in found] == [(12, None), (None, None), (3, [1]), (None, None)]


def test_clashing_names(spark):
    names = ["_reply", "_error", "_prompt", "_pack", "_packs", "_lost", "record", "records", "k0", "v0", "error", "lost", "one", "two"]
    df = spark.createDataFrame([tuple("abcdefghijklmn"), tuple("ABCDEFGHIJKLMN")], ", ".join(f"{n} string" for n in names))

    def model(prompts):
        return ['{"v0": "1", "error": "2"}' if "object" in p or "records" in p and "Fields" in p else "true" for p in prompts]

    judge = Judge(model=model)
    assert semantic.sem_filter(df, "c", judge).columns == names and semantic.sem_filter(df, "c", judge).count() == 2
    assert {(r.v0, r.error, r._reply) for r in semantic.sem_map(df, [Field("v0"), Field("error")], judge).collect()} == {("1", "2", "a"), ("1", "2", "A")}
    found = semantic.sem_groupby(df, [Field("record"), Field("k0")], [("_lost", "sum it up", "error"), ("v0", "count", "lost")], judge)
    assert sorted((r.record, r.k0, r.error, r.lost) for r in found.collect()) == [("G", "I", "2", 1), ("g", "i", "2", 1)]


def test_frame_steps(spark, animals):
    frame = SemFrame(animals, Judge(rules={"heavy": lambda d: F.col("weight") > 100}))
    heavy = frame.sem_filter("heavy")
    assert heavy.code("SELECT max(weight) AS w FROM {rows}").df.first().w == 6200
    rows, answer = heavy.code(lambda d: d.orderBy(F.desc("weight"))).limit(1).reason("{animal} is heaviest", "animal")
    assert answer == "elephant is heaviest" and rows.count() == 1
    assert frame.limit(0).df.count() == 0
    assert frame.union(heavy).df.count() == 7
    with pytest.raises(ValueError):
        frame.sample("animal", 0)


def test_parsers():
    assert parse_boolean("It is TRUE.") == "true" and parse_boolean("False") == "false"
    assert parse_boolean("true/false") is None and parse_boolean("") is None
    assert parse_json('x ```json\n{"a": [1]}\n``` y') == '{"a": [1]}' and parse_json("[1, 2]") == "[1, 2]" and parse_json("{oops") is None


def _bounded(budget, model):
    """A model that refuses prompts over its context."""

    def checked(prompts):
        assert max(len(p) // 4 + 1 for p in prompts) <= budget, max(map(len, prompts))
        return model(prompts)

    return checked


@pytest.mark.parametrize("budget", [130, 700])
def test_no_pack_exceeds_its_budget(spark, budget):
    r = random.Random(budget)
    rows = [(r.choice("abc"), i, 'x"\n\\é漢' * int(r.paretovariate(0.7) % 300)) for i in range(300)] + [("hot", 7, "same")] * 900 + [("one", 5, None), (None, 1, "n" * 9000)]
    df = spark.createDataFrame(rows, "k string, weight long, text string").repartition(7)

    def model(prompts):
        found = []
        for p in prompts:
            records = [json.loads(x) for x in json.loads(_record(p)["records"])]
            found.append(json.dumps({"total": sum(int(x.get("weight", x.get("total"))) for x in records)}))
        return found

    totals = Counter()
    for k, n, _ in rows:
        totals[k] += n
    fields, judge = [Field("total", "bigint")], Judge(model=_bounded(budget, model))
    found, _ = semantic._reduced(df, ["k"], "Add.", fields, judge, budget)
    assert {x.k0: x.v0 for x in found.collect()} == totals
    assert semantic.sem_aggregate(df.drop("k"), "Add.", fields, Judge(model=_bounded(budget, model), context=budget)).first().total == sum(totals.values())
    with pytest.raises(ValueError, match="leave"):
        semantic.sem_aggregate(df, "Add. " * 2000, fields, judge, budget=budget)


def test_records_are_cut_by_likeness_to_the_task(spark):
    text = "nothing here. " * 140_000
    rows = [(1, text[:1_000_000] + " zebra " + text[1_000_000:]), (2, text), (3, "zebra"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    likeness = lambda texts: [[float("zebra" in t), 0.1] for t in texts]
    seen = lambda prompts: [str("zebra" in (_record(p)["text"] or "")) for p in prompts]
    found = semantic.sem_filter(df, "A zebra is named.", Judge(model=_bounded(400, seen), context=400, embed=likeness), columns=["text"])
    assert {r.id: r.text for r in found.collect()} == {1: rows[0][1], 3: "zebra"}  # rows stay whole
    blind = Judge(model=_bounded(400, seen), context=400)
    assert {r.id for r in semantic.sem_filter(df, "A zebra is named.", blind, columns=["text"]).collect()} == {3}
    both = lambda prompts: [str(all("zebra" in (_record(p)[k] or "") for k in ("left_text", "right_text"))) for p in prompts]
    pairs = semantic.sem_join(df.withColumn("k", F.lit(1)), df.withColumn("k", F.lit(1)), "A zebra in both.", Judge(model=_bounded(400, both), context=400, embed=likeness), on=[("k", "k")])
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == {(1, 1), (1, 3), (3, 1), (3, 3)}


def test_fitting_of_one_record():
    long = {"a": "x" * 5000, "b": ["y" * 5000, 7, None], "c": {"d": '"\n' * 4000}, "n": 12}
    for wraps in (0, 2):
        for limit in (150, 1000, 9000):
            found = Fitter("t", wraps=wraps).fit(json.dumps(long), limit)
            assert len(fitting.escaped(found, wraps)) <= limit and json.loads(found)["n"] == 12
    assert json.loads(Fitter("t").fit(json.dumps({"n": list(range(5000)), "a": "b"}), 200))["n"].startswith("[0,1,2")
    assert Fitter("t").fit('{"a":"b"}', 9) == '{"a":"b"}'
    with pytest.raises(ValueError):
        Fitter("t").fit(json.dumps({"k" * 500: "v" * 500}), 100)


def test_a_retry_names_the_reason(spark, animals):
    prompts_seen = spark.sparkContext.accumulator(0)

    def model(prompts):
        again = [p for p in prompts if "either true or false. It was: maybe so" in p.split("\n")[0]]
        prompts_seen.add(len(again))
        return ["true" if p in again else "maybe\nso" for p in prompts]

    assert semantic.sem_filter(animals, "x", Judge(model=_bounded(100, model), context=100)).count() == 5
    assert prompts_seen.value == 5


def test_failures_are_asked_anew(spark, animals, tmp_path):
    broken = tmp_path / "broken"
    broken.touch()
    place = str(broken)

    def model(prompts):
        import os

        return ["?" if os.path.exists(place) and "eagle" in p else "true" for p in prompts]

    judge = Judge(model=model)
    assert semantic.sem_filter(animals, "x", judge).count() == 4
    broken.unlink()
    assert semantic.sem_filter(animals, "x", judge).count() == 5
    assert semantic.sem_filter(animals, "x", judge).count() == 5
