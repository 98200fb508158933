import random

import pytest

WORDS = [a + b for a in "ba ko mi tu re sa lo".split() for b in "na dor the ing el os".split()]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows and ids, signs of several bytes, clashing column names."""
    long = prose(1, 20_000)
    texts = [
        None, "", "  \n\t", "one", "one", prose(2, 80), prose(2, 80) + " more words here", prose(3, 300), prose(3, 300), long, long[:-900],
        "ünï " * 90, "ünï " * 90 + "漢字", "a" * 700, prose(4, 60) + "\n" + prose(3, 300)[:400], "x\x00y <|endoftext|> z",
    ]
    rows = [(i, t, "k", i, "c", 1.0) for i, t in enumerate(texts)] + [(3, "one", "k", 3, "c", 1.0), (None, "no id", "k", 0, "c", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, n long, bits string, score double")
