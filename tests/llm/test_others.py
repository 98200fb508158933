import base64
import glob
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import embeddings, language_model, queries, sharding, warc
from lumora.llm.shared import new_path, roots
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name]))


def test_scores_awkward(spark, awkward):
    rows = {r.doc_id: r for r in language_model.score(awkward, block_bytes=4000).collect()}
    whole = {r.doc_id: r for r in language_model.score(awkward).collect()}
    assert all(math.isclose(rows[i].log_score, whole[i].log_score, abs_tol=1e-6) and rows[i].n_backoff == whole[i].n_backoff for i in rows)
    assert rows[0].n_words == rows[1].n_words == 0 and rows[0].log_score == 0
    assert language_model.score(awkward.limit(0)).count() == 0


def slow_scores(texts, order, alpha, min_count, own):
    """log score, words that took a step and unseen words of each text; `own` leaves a text's own counts out."""
    docs = [(t or "").lower().split() for t in texts]
    grams = lambda d: Counter(tuple(d[i : i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))
    whole = sum(map(grams, docs), Counter())
    found = []
    for d in docs:
        count = whole - grams(d) if own else whole
        total = max(1, sum(n for g, n in count.items() if len(g) == 1))
        log, steps, unseen = 0.0, 0, 0
        for i in range(len(d)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - n + 1 : i + 1])
                if count[gram] >= (min_count if n > 1 else 1):
                    break
            else:
                n = 0
            longest = min(order, i + 1)
            unseen += n == 0
            steps += n < longest
            log += math.log(alpha) * (longest - n) + (math.log(count[gram] / (count[gram[:-1]] if n > 1 else total)) if n else -math.log(total))
        found.append((log, steps, unseen))
    return found


@pytest.mark.parametrize("order, min_count, own", [(2, 1, True), (3, 1, True), (3, 2, False), (2, 1, False), (1, 1, True)])
def test_scores_against_brute_force(spark, order, min_count, own):
    r = random.Random(order)
    texts = ["a b c a b c", "a b d", "c a b c", "A b d", "", None, "z", "z z", *(" ".join(r.choices("abcdefgh", k=r.randint(1, 30))) for _ in range(30))]
    texts += [texts[-1], "only here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = language_model.score(df, order=order, alpha=0.5, min_count=min_count, leave_one_out=own, block_bytes=100).orderBy("doc_id").collect()
    for row, (log, steps, unseen) in zip(got, slow_scores(texts, order, 0.5, min_count, own), strict=True):
        assert math.isclose(row.log_score, log, abs_tol=1e-9) and (row.n_backoff, row.n_unseen) == (steps, unseen), row


def test_scores_of_equal_rows_and_one_long_text(spark):
    """Equal rows are one block's task's single row with its number of copies; a text longer than a block is whole."""
    df = spark.createDataFrame([(1, "a b a c")] * 50 + [(1, "x y"), (2, "a b " * 3000), (None, None)], "doc_id long, text string").repartition(4)
    rows = language_model.score(df, block_bytes=500).groupBy("doc_id", "n_words", "n_backoff", "log_score").count().collect()
    assert sorted((r.n_words, r["count"]) for r in rows) == [(0, 1), (2, 1), (4, 50), (6000, 1)]
    want = slow_scores(["a b a c"] * 50 + ["x y", "a b " * 3000], 2, 0.4, 1, True)
    assert all(any(math.isclose(r.log_score, w[0], abs_tol=1e-6) for w in want) for r in rows if r.n_words)


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(300, 16))
    near = np.concatenate([base[:40] + r.normal(size=(40, 16)) * 0.1, base[7] + r.normal(size=(150, 16)) * 0.15])
    x = np.concatenate([base, near, base[:3], np.zeros((1, 16))])
    rows = [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]
    rows += [(900, None, 0, 1), (901, [], 0, 1), (902, [None] * 16, 0, 1), (903, [float("nan")] * 16, 0, 1), (904, [float("inf")] + [1.0] * 15, 0, 1), (905, [1.0, 2.0], 0, 1), (0, rows[0][1], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, rep int")
    found = embeddings.near_duplicates(df, part=40).collect()
    assert len(found) == len(rows)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    want = hit.sum(axis=1)
    want += hit[:, 0]  # the repeated row of vector 0
    want[0] += 1
    got = np.zeros(len(x), dtype=int)
    for f in found:
        if f.vec_id < len(x):
            got[f.vec_id] = f.n_links
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    odd = {f.vec_id: (f.n_links, f.component_id) for f in found if f.vec_id >= 900 or f.vec_id == len(x) - 1}
    assert all(v == (0, k) for k, v in odd.items())
    comp = {f.vec_id: f.component_id for f in found}
    assert len({comp[i] for i in range(340, 490)}) == 1
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def linked(spark, vectors, **options):
    """n_links and component_id of each vector, with those that brute force gives."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = {f.vec_id: (f.n_links, f.component_id) for f in embeddings.near_duplicates(df, **options).collect()}
    unit = [v / np.linalg.norm(v) for v in vectors]
    hit = np.array([[len(a) == len(b) and a @ b >= 0.9 for b in unit] for a in unit])
    least = roots(len(vectors), *np.nonzero(hit))
    return [rows[i] for i in range(len(vectors))], [(int(n) - 1, int(c)) for n, c in zip(hit.sum(axis=1), least, strict=True)]


def test_embeddings_of_one_cone(spark):
    r = np.random.default_rng(5)
    cone = np.eye(12)[0] + r.normal(size=(150, 12)) * 0.12  # one pivot: all lie within a cosine of 0.5 of each other
    got, want = linked(spark, cone, part=40)
    assert got == want and len({c for _, c in want}) > 1 and sum(n for n, _ in want) > 150
    assert linked(spark, np.array([[1.0, 0.0], [0.95, 0.3122]]))[0] == [(1, 0), (1, 0)]


def test_embeddings_of_several_lengths(spark):
    r = np.random.default_rng(6)
    base = r.normal(size=(60, 8))
    vectors = [*base, *(base[:30] + r.normal(size=(30, 8)) * 0.1)]
    other = r.normal(size=(20, 5))
    vectors += [*other, *(other + r.normal(size=(20, 5)) * 0.1), np.array([1.0, 2.0]), np.array([1.0, 2.1]), np.ones(3)]
    r.shuffle(order := list(range(len(vectors))))
    got, want = linked(spark, [vectors[i] for i in order], part=20)
    assert all(g[0] <= w[0] for g, w in zip(got, want, strict=True))
    assert sum(g[0] for g in got) >= 0.9 * sum(w[0] for w in want)
    short = [k for k, i in enumerate(order) if len(vectors[i]) != 8]
    assert [got[k] for k in short] == [want[k] for k in short] and sum(want[k][0] for k in short) >= 40


def test_embedding_recall(spark):
    """Links found of those there are, over a whole table."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    found = queries.op6_embeddings(spark, "/root/testdata/sf0.1").orderBy("vec_id").collect()
    got = np.array([f.n_links for f in found])
    assert (got <= hit.sum(axis=1)).all() and got.sum() >= 0.9 * hit.sum()


def pages(spark):
    html = "<p>WARC/1.1\r\n\r\nWARC-Type: response\r\n</p>"
    rows = [(5, "http://a/\r\nX: y", html), (2, "http://b/", html), (9, None, html), (3, "http://c/", None), (4, "http://d/", ""), (7, "http://e/", "ünï"), (7, "http://e/", "ünï"), (None, "http://f/", "ünï"), (8, "http://g/", "z" * 300_000)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")


@pytest.mark.parametrize("least", [0, 4, 10**9])
def test_warc_round_trip(spark, least):
    df = pages(spark)
    path = new_path(spark, "warc-test")
    warc.write(warc.resolve(df, least_bytes=least), path, records_per_file=3)
    records = warc.read(spark, path).collect()
    assert len(records) == df.count()
    rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.restored(warc.read(spark, path)).collect()), key=str)
    want = []
    for page, payload in rows:
        first = min(p for p, b in rows if b == payload and p is not None) if len(payload) >= least else None
        again = first is not None and page != first
        want.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert found == sorted(want, key=str)
    for r in records:
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == r.declared_digest
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    assert len(files) > 1
    for file in files:
        members = list(gzip_members(open(file, "rb").read()))
        assert members[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and len([x for x in members if x]) <= 3
        assert all(m.count(b"WARC-Record-ID") == 1 and b"\r\nWARC-Date: 20" in m for m in members if m)  # one record each
        assert all(b"\r\nWARC-Target-URI: " in m for m in members[1:] if m)
    empty = new_path(spark, "warc-empty")
    warc.write(warc.resolve(df.limit(0)), empty)
    assert warc.read(spark, empty).count() == 0


def gzip_members(data):
    while data:
        one = zlib.decompressobj(wbits=31)
        yield one.decompress(data)
        data = one.unused_data


FOREIGN = """WARC/1.0\r
WARC-Type: warcinfo\r
WARC-Record-ID: <urn:uuid:1>\r
Content-Length: 5\r
\r
a: b\n\r
\r
WARC/1.0\r
warc-type:response\r
WARC-Record-ID:<urn:uuid:2>\r
WARC-Target-URI:http://x/\r
X-Long: one\r
 two\r
Content-Length:{0}\r
\r
HTTP/1.1 200 OK\r
A: b\r
\r
{1}\r
\r
WARC/1.0\r
WARC-Type: request\r
WARC-Record-ID: <urn:uuid:3>\r
Content-Length: 18\r
\r
GET / HTTP/1.1\r
\r
\r
\r
WARC/1.0\r
WARC-Type: revisit\r
WARC-Record-ID: <urn:uuid:4>\r
WARC-Payload-Digest: sha1:{2}\r
Content-Length: 0\r
\r
\r
\r
WARC/1.0\r
WARC-Type: revisit\r
WARC-Record-ID: <urn:uuid:5>\r
WARC-Refers-To: <urn:uuid:2>\r
Content-Length: 0\r
\r
\r
\r
"""


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives(spark, tmp_path, packed):
    """Other types of records, headers without blanks or of other case, no page numbers, one gzip member or none."""
    body = "x" * 70_000
    digest = base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
    data = FOREIGN.replace("{0}", str(len(body) + 25)).replace("{1}", body).replace("{2}", digest).encode()
    (tmp_path / "a.warc").write_bytes(zlib.compress(data, wbits=31) if packed else data)
    found = {r.record_id[10]: r for r in warc.restored(warc.read(spark, str(tmp_path))).collect()}
    assert {k: (r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for k, r in found.items()} == {
        "2": (None, 70_000, digest, "response"), "4": (None, 70_000, digest, "revisit"), "5": (None, 70_000, digest, "revisit"),
    }
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse((whole := (tmp_path / "a.warc").read_bytes())[: len(whole) // 2]))


def test_shards_fit(spark, awkward):
    for limit in (500, 20_000, 10**9):
        path = new_path(spark, "shards-test")
        sizes = sharding.write(awkward, path, limit=limit, file_bytes=3 * limit).collect()
        rows = spark.read.schema("doc_id long, text string, depth int, shard string").parquet(path)
        assert rows.count() == awkward.count() == sum(s.n_docs for s in sizes)
        real = {r.shard: (r.b, r.n) for r in rows.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
        assert real == {s.shard: (s.n_bytes, s.n_docs) for s in sizes}
        assert all(b <= limit or n == 1 for b, n in real.values())
        names = sorted(real)
        assert not any(b.startswith(a) for a, b in zip(names, names[1:]))  # no shard is part of another
        place = {r.shard: r.file for r in sharding.placed(spark, path).collect()}
        one = names[len(names) // 2]
        assert sharding.shard(spark, path, one, place[one]).count() == real[one][1] and set(place) == set(real)
        assert len(set(place.values())) <= max(1, len(real) - 1) or limit == 500
    assert len(real) == 1
    assert sharding.write(awkward.limit(0), new_path(spark, "shards-empty"), limit=10).count() == 0


def test_repeated_ids_part(spark):
    df = spark.createDataFrame([(1, "x" * 50)] * 40 + [(None, "y" * 50)] * 10, "doc_id long, text string")
    path = new_path(spark, "shards-repeated")
    sizes = sharding.write(df.repartition(3), path, limit=200).collect()
    assert sum(s.n_docs for s in sizes) == 50 and all(s.n_bytes <= 200 for s in sizes)
    assert spark.read.parquet(path).count() == 50
