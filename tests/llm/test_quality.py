import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumora.llm import quality, queries
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    found = queries.op3_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted == 0 for r in good) / len(good) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_held_out_rows_and_nothing_else_is_read(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    a = quality.fit(docs, labels)
    rows = queries.op3_quality(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    lies = labels.withColumn("quality", quality.held_out(labels.doc_id).cast("int") * (1 - labels.quality) + (~quality.held_out(labels.doc_id)).cast("int") * labels.quality)
    b = quality.fit(docs, lies)  # other labels in the held-out quarter change nothing
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_awkward(spark, awkward):
    labels = spark.createDataFrame([(0, 1), (3, None), (None, 0), (5, 0), (5, 1), (7, 1), (9, 0), (99, 1)], "doc_id long, quality int")
    model = quality.fit(awkward, labels)
    found = quality.scored(awkward, model).collect()
    assert len(found) == awkward.count() and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (0, 1, 2)}) == 1
    assert quality.kept(awkward, model, threshold=0.0).columns == awkward.columns
    assert quality.kept(awkward, model, threshold=0.0).count() == awkward.count()
    assert quality.scored(awkward.limit(0), model).count() == 0
    empty = quality.fit(awkward, labels.limit(0))
    assert quality.kept(awkward, empty).count() == awkward.count()
    assert {r.score for r in quality.scored(awkward, empty).collect()} == {0.5}


def plain_ftrl(rows, alpha=0.5, beta=1.0, l1=0.0, l2=1e-3, epochs=2):
    """Follow the regularised leader, one n-gram after the other, over dicts."""
    mask = (1 << 64) - 1

    def shape(word):
        out = ""
        for kind, run in ((k, "".join(g)) for k, g in itertools.groupby(word, lambda c: "a" if re.fullmatch(r"[^\W\d_]", c) else "0" if re.fullmatch(r"\d", c) else c)):
            out += ("A" if run.isupper() else "a" if run.islower() else "Aa") if kind == "a" else "0" if kind == "0" else run
        return out

    def grams(text):
        words = [w.decode("utf-8", "replace") for w in text.split()]
        found = Counter()
        for sides in zip(*[(zlib.crc32("".join(re.findall(r"[^\W\d_]+", w.lower())).encode()), zlib.crc32(b"\0" + shape(w).encode())) for w in words], strict=True):
            for x in sides:
                found[(x * 0xD6E8FEB86659FD93 & mask) >> 46] += 1
            for x, y in itertools.pairwise(sides):
                pair = 0 if x == y else (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F) & mask
                found[pair >> 46] += 1
        return {k: n / max(1, len(words)) for k, n in found.items()} | {"bias": 1.0}

    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else ((l1 if z[k] > 0 else -l1) - z[k]) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for text, label in rows:
            x = grams(text)
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[k] * v for k, v in x.items())))))
            for k, v in x.items():
                g = (p - label) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * w[k]
                n[k] += g * g
    return {k: weight(k) for k in list(z)}


@pytest.mark.parametrize("l1", [0.0, 0.05])
def test_same_weights_as_plain_ftrl(spark, l1):
    """The model's weights, on 200 labelled documents and odd texts, and its scores."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    rows = [(r.text[:3000].encode(), r.quality) for r in docs.join(labels, "doc_id").orderBy("doc_id").limit(200).collect()]
    rows += [(b"", 1), ("Ünï ünï 12ab34 _x_ !! !! A".encode(), 0), (b"\xff\xfe bad", 1), (b"one", 0)]
    model, want = quality.ftrl(rows, l1=l1), plain_ftrl(rows, l1=l1)
    assert abs(model.bias - want.pop("bias")) < 1e-9
    found = {k: float(model.weights[k]) for k in np.flatnonzero(model.weights).tolist()}
    assert all(abs(found.get(k, 0.0) - w) < 1e-5 for k, w in want.items()) and set(found) <= set(want)
    text = rows[3][0]
    n = len(text.split())
    at, _ = quality.features(text)
    z = model.bias + sum(want.get(int(k), 0.0) for k in at) / n
    assert abs(model.score(text) - 1 / (1 + math.exp(-z))) < 1e-5
