import re

from lumora.llm import decontamination
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(texts, items, n=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in items:
        own = WORD.findall(lower(t))
        for k in range(max(1, len(own) - n + 1) if own and i is not None else 0):
            windows.setdefault(tuple(own[k : k + n]), set()).add(i)
    found = []
    for t in texts:
        own, hit, which = WORD.findall(lower(t)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                if of := windows.get(tuple(own[k : k + size])):
                    hit |= set(range(k, k + size))
                    which |= of
        found.append((len(own), len(hit), sorted(which)))
    return found


def test_awkward_in_one_or_many_groups(spark, awkward):
    passage = prose(3, 300)
    items = [(1, passage[200:700]), (1, passage[200:700]), (2, "ONE"), (3, None), (4, "--"), (None, "one"), (5, prose(77, 30)), (6, passage[300:500].upper()), (7, "ünï ünï")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for group_bytes in (1 << 20, 300):
        found = decontamination.find(awkward, bench, group_bytes=group_bytes).collect()
        rows = awkward.collect()
        want = slow([r.text for r in rows], items)
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.items) for r in found), key=str)
        assert got == sorted(((r.doc_id, *w) for r, w in zip(rows, want, strict=True)), key=str)
        kept = decontamination.kept(awkward, bench, group_bytes=group_bytes)
        assert kept.columns == awkward.columns and kept.count() == sum(not w[1] for w in want)
        texts = {r.doc_id: (r.text or "").encode() for r in rows}
        for r in found:
            cut = b" ".join(texts[r.doc_id][s.start : s.end] for s in r.spans).decode() if r.doc_id is not None else ""
            assert r.doc_id is None or len(WORD.findall(cut.lower())) == r.n_hit
    assert decontamination.find(awkward.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontamination.find(awkward, bench.limit(0)).collect()} == {0}


def test_query(spark):
    from lumora.llm import queries
    from tests.conftest import DATA

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {i: (*w[:2], len(w[2])) for (i, _), w in zip(docs, slow([t for _, t in docs], items), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in queries.op8_decontamination(spark, DATA).collect()} == want
