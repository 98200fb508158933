import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumora.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows, heads=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if heads else 0
        whole[c] = (own.get(c - c % 20, [])[:h] if h else []) + turns[h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def below(p):
        leaves, saved = 0 if children[p] else 1, (len(members[p]) - 1) * (len(p[-1][1].encode().split()) if p else 0)
        for q in children[p]:
            x, y = below(q)
            leaves, saved = leaves + x, saved + y
        return leaves, saved

    found = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        found.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=repr)


def conversations(seed, n=150):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", None, "assistant"]), r.choice(["hi there", "", None, "a b  c\n", "x"])) for c in range(n) for t in range(r.randint(0, 5))]
    rows += [(500, None, "user", "x"), (500, None, "user", "x"), (500, None, "user", "a"), (500, 3, "ab", "c"), (501, 3, "a", "bc"), (None, 1, "user", "x")]
    return rows


def run(spark, rows, **options):
    turns, convs = trie.with_heads(trie.ordered(spark.createDataFrame(rows, SCHEMA)))
    return trie.nodes(turns, convs, **options)


@pytest.mark.parametrize("moduli", [trie.MODULI, (11, 13)])
def test_against_brute_force(spark, moduli):
    """Small moduli make fingerprints collide, and what collides is split."""
    rows = conversations(1)
    assert got(run(spark, rows, moduli=moduli)) == slow(rows)


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds most turns, more than a batch, and another one all but its last."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        long = [(c, t, "user", f"turn {t % 7}" if t else "first") for c, n in ((7, 700), (8, 699), (9, 12)) for t in range(n)]
        turns, convs = trie.with_heads(trie.ordered(spark.createDataFrame(long, SCHEMA)), most=1)
        assert got(trie.nodes(turns, convs)) == slow(long, heads=False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(trie, "PACKED", 7)
    rows = [(c, 0, "user", "same") for c in range(-40, 200)]
    assert got(run(spark, rows)) == slow(rows)


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert run(spark, []).count() == 0 and trie.ordered(none).count() == 0
    rows = conversations(2, 40)
    extra = spark.createDataFrame(rows, SCHEMA).select("*", *[F.col("turn").alias(x) for x in ("conv", "k", "fp", "part", "depth", "split")])
    assert got(trie.nodes(*trie.with_heads(trie.ordered(extra)))) == slow(rows)
    long = [(1, 0, "user", "word " * 300_000), (2, 0, "user", "word " * 300_000)]
    assert got(run(spark, long)) == slow(long)
