import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lumora.llm import spelling


def slow_words(rows, length, least, noise):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def slow_variants(counts, ratio):
    near = defaultdict(list)
    for a in counts:
        for b in counts:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for a in counts:
        best = min(near[a], key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best and counts[best] >= ratio * counts[a] else None

    def root(a):
        while form[a]:
            a = form[a]
        return a

    return {a: (counts[a], form[a], root(a), len(near[a]), counts[form[a]] if form[a] else None) for a in counts}


def found(df):
    return {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed, letters, size", [(1, "ab", 7), (2, "abcÀé", 8), (3, "abcdefgh漢😀", 9), (4, "aab", 25)])
def test_variants_against_all_pairs(spark, seed, letters, size):
    r = random.Random(seed)
    words = {"".join(r.choices(letters, k=size + r.choice([0, 0, 1, 2]))) for _ in range(150)}
    for w in list(words):  # each kind of edit at each end and within
        for at in (0, len(w) // 2, len(w) - 1):
            words |= {w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]}
    counts = {w: r.choice([1, 2, 3, 20, 30, 300, 4000, 4000]) for w in words if len(w) > 3}
    given = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    assert found(spelling.variants(given, ratio=10)) == slow_variants(counts, 10)


def test_words_awkward(spark, awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for noise in (0, 3):
        got = {r.word: r.n for r in spelling.words(awkward, length=3, least=2, noise=noise).collect()}
        assert got == slow_words(rows, 3, 2, noise)
    assert spelling.words(awkward.limit(0)).count() == 0
    assert spelling.variants(spelling.words(awkward.limit(0))).count() == 0
    extra = awkward.select("*", *[awkward.doc_id.alias(x) for x in ("id", "word", "key")])
    assert {r.word: r.n for r in spelling.words(extra, length=3, least=2).collect()} == slow_words(rows, 3, 2, 0)


def test_chain_of_forms(spark):
    counts = {"aaaaaaa": 10**7, "aaaaaab": 10**5, "aaaaabb": 1000, "aaaabbb": 10, "aaabbbb": 1, "a" * 20_000: 1, "a" * 20_001: 10}
    got = found(spelling.variants(spark.createDataFrame([*counts.items(), (None, 3)], "word string, n long"), ratio=10))
    assert got == slow_variants(counts, 10) and got["aaabbbb"][2] == "aaaaaaa"
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], "word string, n long"), ratio=1)
