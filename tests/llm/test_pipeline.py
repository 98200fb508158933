import random

from pyspark.sql import functions as F

import corpus_pipeline
from lumora.llm import queries
from tests.conftest import DATA
from tests.llm.test_packing_tokens import check_sequences, ids_of


def staged(spark, docs):
    from lumora.llm.shared import written

    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        out.append(docs)
    return out


def test_planted_cases(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    good = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").join(table, "doc_id").where("n_chars > 3000").orderBy("doc_id").limit(6).collect()
    clean = [r.text for r in good]
    r = random.Random(9)
    words = clean[0].split(" ")
    near = list(words)
    for i in r.sample(range(len(words)), max(1, len(words) // 80)):
        near[i] = "altered"
    passage = " ".join(clean[5].split()[:70])
    rows = [
        (10_000_001, clean[0]), (10_000_002, clean[0]), (10_000_003, " ".join(near)),
        (10_000_004, clean[1] + " " + bench), (10_000_005, clean[2] + "\n" + passage), (10_000_006, clean[3] + "\n" + passage),
        (10_000_007, "$$$ ### %%%! " * 80), (10_000_007, clean[4]), (10_000_007, clean[4]),
    ]
    planted = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    odd = spark.createDataFrame([(None, clean[4] + " no id", "en", "s", 1), (10_000_010, None, None, None, None), (10_000_011, "", "en", "s", 0)], planted.schema)
    quality, one, unrepeated, clear, packed = staged(spark, planted.unionByName(odd).repartition(3))
    assert 10_000_007 in {x.doc_id for x in quality.collect()}
    assert sum(x.doc_id == 10_000_007 for x in quality.collect()) == 2  # the junk row of that id went
    kept = [x.doc_id for x in one.collect()]
    assert kept.count(10_000_001) == 1 and not {10_000_002, 10_000_003} & set(kept) and kept.count(10_000_007) == 1 and kept.count(None) == 1
    texts = {x.doc_id: x for x in unrepeated.collect()}
    assert passage[:300] not in texts[10_000_005].text and texts[10_000_005].text.startswith(clean[2][:100])
    assert all(x.n_chars == len(x.text) for x in texts.values())
    assert 10_000_004 not in {x.doc_id for x in clear.collect()} and 10_000_001 in {x.doc_id for x in clear.collect()}
    for frame in (quality, one, unrepeated, clear):
        assert frame.columns == planted.columns
    check_sequences(packed.collect(), 1024)
    assert all(f(spark, planted.limit(0), DATA).count() == 0 for _, f in corpus_pipeline.STAGES)


def test_run(spark):
    *_, clear, packed = staged(spark, spark.read.parquet(f"{DATA}/documents.parquet"))
    rows = clear.collect()
    ids = {r.doc_id: i for r, i in zip(rows, ids_of([r.text for r in rows]), strict=True)}
    found = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in found} == set(ids) and sum(r.length for r in found) == sum(map(len, ids.values()))
    for r in found:
        assert bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes()
    assert packed.agg(F.sum("length")).first()[0] == sum(r.length for r in found)
    contaminated = {r.doc_id for r in queries.op8_decontamination(spark, DATA).where("contaminated").collect()}
    assert not contaminated & set(ids)
