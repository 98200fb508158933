import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from lumora.llm import queries, simhash
from lumora.llm.shared import components, roots
from tests.conftest import DATA


def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, linked):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def check(found, texts, k, distance):
    fps = {i: slow_fingerprint(t, k) for i, t in texts.items()}
    linked = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= distance]
    least = slow_components(fps, linked)
    for r in found:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == fps[r.doc_id] and r.component_id == least[r.doc_id]


def test_awkward(spark, awkward):
    found = simhash.near_duplicates(awkward, shingle=4).collect()
    assert len(found) == awkward.count()
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id is not None}
    check(found, texts, 4, 4)
    assert {r.component_id for r in found if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0
    assert simhash.similar(awkward.limit(0)).count() == 0


def test_query(spark):
    found = queries.op1_simhash(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    fps = {i: slow_fingerprint(t, 4) for i, t in texts.items()}
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" for r in found) and len(found) == len(texts)
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], dtype=np.uint64)
    want = roots(len(x), *np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4))  # all pairs
    assert {r.doc_id: r.component_id for r in found} == {i: ids[k] for i, k in zip(ids, want, strict=True)}


def test_clashing_columns_and_few_broadcast_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "one two three four five six") for i in range(5)] + [(9, "else"), (None, "else"), (None, None)], "doc_id long, text string")
    docs = docs.withColumns({x: F.lit("x") for x in ("component", "node", "uid", "key", "least", "fp", "component_id")})
    for most in (0, 100):  # joined by shuffle, and broadcast
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
        found = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
        assert found == sorted([*((i, 0) for i in range(5)), (9, 9), (None, 9), (None, None)], key=str)


@pytest.mark.parametrize("distance, blocks", [(4, 5), (4, 6), (4, 8), (2, 3), (0, 1)])
def test_close_pairs_agree_under_a_mask(distance, blocks):
    r = random.Random(5)
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), distance):
            b ^= 1 << bit
        assert any((a ^ b) & m % (1 << 64) == 0 for m in simhash.masks(distance, blocks))


def test_dense_groups_give_a_forest():
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(6)]
    x = np.unique(np.array([base[i % 6] ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for i in range(400)], dtype=np.uint64))
    a, b = simhash._links(x[:, None], 4)
    far = np.bitwise_count(x[:, None] ^ x[None, :])
    assert (far[a, b] <= 4).all()
    want = roots(len(x), *np.nonzero(far <= 4))
    assert (roots(len(x), a, b) == want).all()
    assert len(a) < 20 * len(x)


def test_parts_of_a_bucket_lose_nothing(spark):
    from pyspark.sql import functions as F

    r = random.Random(7)
    fps = sorted({(1 << 40) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(300)})
    df = spark.createDataFrame([(i, [x - (1 << 64) if x >> 63 else x]) for i, x in enumerate(fps)], "node long, fp array<long>")
    keys = [F.col("fp")[0].bitwiseAND(F.lit(m)) for m in simhash.masks(4, 6)]
    want = roots(len(fps), *np.nonzero(np.bitwise_count(np.array(fps, dtype=np.uint64)[:, None] ^ np.array(fps, dtype=np.uint64)[None, :]) <= 4))
    found = simhash.links(df, keys, distance=4, part=20).collect()
    got = roots(len(fps), np.array([x.a for x in found]), np.array([x.b for x in found]))
    assert (got == want).all()


def test_similar_texts_are_linked(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(40):
        own = [r.choice(words) for _ in range(400)]
        rows.append((2 * i, " ".join(own)))
        for at in r.sample(range(400), 4):  # about 20 of 396 shingles change: similarity 0.9
            own[at] = "changed"
        rows.append((2 * i + 1, " ".join(own)))
    found = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[2 * i] == found[2 * i + 1] == 2 * i for i in range(40))


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _jaccard(a, b):
    a, b = _shingles(a), _shingles(b)
    return len(a & b) / len(a | b)


def test_recall_and_false_links_about_the_threshold(spark):
    r, rows, want = random.Random(9), [], {}
    words = [f"w{i}" for i in range(5000)]
    for i in range(240):
        common = [r.choice(words) for _ in range(300)]
        alone = round(300 * (1 / (0.70 + 0.15 * i / 239) - 1) / 2)  # similarities from about 0.70 to 0.85
        pair = [" ".join(common + [r.choice(words) for _ in range(alone)]) for _ in range(2)]
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
        want[i] = _jaccard(*pair) >= 0.8
    found = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {i: found[2 * i] == found[2 * i + 1] for i in want}
    assert not any(got[i] for i in want if not want[i])
    assert 60 < sum(want.values()) < 120 and sum(got[i] for i in want if want[i]) >= 0.92 * sum(want.values())


def test_repeated_lines_and_parts_of_dense_groups(spark):
    r = random.Random(10)
    words = [r.choice("abcdefghij") + str(r.randrange(900)) for _ in range(300)]
    line = " ".join(words[40:60])
    rows = [(1, " ".join(words)), (2, " ".join([*words[:60], *[line] * 300, *words[60:]]))]
    found = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1}
    base, sets = [r.getrandbits(62) for _ in range(400)], []
    for _ in range(60):
        sets.append(np.unique(r.sample(base, r.randint(330, 370)) + [r.getrandbits(62) for _ in range(8)]))
    hit = np.array([[len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) for b in sets] for a in sets])
    a, b = simhash._alike(np.zeros((60, 4), np.uint64), np.zeros(60), np.concatenate(sets), np.cumsum([0, *map(len, sets)]), 62, 0.8)
    assert (roots(60, np.array(a, int), np.array(b, int)) == roots(60, *np.nonzero(hit))).all() and len(a) < 60


def test_unlike_texts_of_one_id_stay(spark):
    import corpus_pipeline

    r = random.Random(11)
    a, b, c = (" ".join(str(r.randrange(10**6)) for _ in range(80)) for _ in range(3))
    rows = [(7, a), (7, b), (7, b), (3, c), (7, c + " more"), (8, a), (None, a)]
    found = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    assert sorted(((x.doc_id, x.text) for x in found), key=str) == sorted([(7, a), (7, b), (3, c), (None, a)], key=str)


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    random.Random(1).shuffle(chain)
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
