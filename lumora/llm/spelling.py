"""Spelling variants: words of a corpus that differ by one letter, found by their rarest bigrams.

A word's positional bigrams are ordered by the frequency of the bigram among all words, the
rarest first. One inserted, deleted or replaced letter changes at most two of them, so two
near words share one of the three rarest of each (prefix filter). The places of the shared
bigram must agree as well: what lies on one side of it is equal in both words, and on the
other side, where they differ, either the first or the last half is. Words are joined on
these parts, so that a common bigram at a common place brings no large group together, and
each candidate is verified by its edit distance.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.shared import dropped, in_order, narrowed, sliced, written

#: Upper-case letters that are lower-cased: A to Z alone.
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
#: Distinct words that a task counts before it passes the counts on.
COUNTED = 200_000
#: Rarest bigrams of a word that it is joined by: those that one edit can change, and one more.
RAREST = 3
#: Letters of a piece in which the edit may lie, as long as a side has at most PIECES pieces; longer sides have longer ones.
PIECE, PIECES = 2, 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 7, least: int = 2, noise: int = 0
) -> DataFrame:
    """word, n: letter runs of at least `length` code points in whole texts, lower-cased in A-Z, at least `least` times.

    With `noise`, one in so many (document, word) pairs loses a letter: where `noise` divides the
    CRC-32 h of "<id>:<word>", code point h % length goes, so that a corpus has known variants.
    Null texts have no words, a null id is written as nothing; rows that are equal count each.
    Words are counted in each task before they are shuffled.
    """
    run = re.compile(f"[A-Za-zÀ-ÿ]{{{length},}}")  # from its start on, a run is matched whole

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: Counter = Counter()

        def counts() -> dict:
            return {"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())}

        for batch in sliced(batches, 200):
            for own, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = Counter(x[0].translate(LOWER) for x in run.finditer(text.as_py() or ""))
                if not noise:
                    total.update(found)
                    continue
                start = zlib.crc32(f"{own or ''}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % noise == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < length:
                            continue
                    total[word] += n
            if len(total) > COUNTED:
                yield counts()
                total.clear()
        yield counts()

    rows = narrowed(docs, id=id_col, text=text_col).select(F.col("id").cast("string"), "text")
    found = rows.mapInArrow(in_order(["word", "n"], body), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points (a row for each word) of the words of each length."""
    texts = column.to_pylist()
    lengths = np.array([len(x) for x in texts], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(at) and lengths[at[0]]:
            codes = np.frombuffer("".join(texts[i] for i in at.tolist()).encode("utf-32-le"), dtype="<u4")
            yield at, codes.reshape(len(at), -1)


def _bigrams(codes: np.ndarray) -> np.ndarray:
    """A 16-bit number for each bigram: of its own for letters below 256, else shared with others, which costs candidates alone."""
    return ((codes[:, :-1].astype(np.int64) << 8) + codes[:, 1:]) & 0xFFFF


def frequencies(found: DataFrame) -> np.ndarray:
    """How many bigrams of the words have each number: at most 65,536 sums, whatever the corpus."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for _, codes in _by_length(batch.column("word")):
                total += np.bincount(_bigrams(codes).ravel(), minlength=1 << 16)
        at = np.flatnonzero(total)
        yield {"gram": pa.array(at), "n": pa.array(total[at])}

    table = np.zeros(1 << 16, dtype=np.int64)
    sums = found.select("word").mapInArrow(in_order(["gram", "n"], body), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for gram, n in sums.collect():
        table[gram] = n
    return table


def _keys(found: DataFrame, rank: np.ndarray, own: bool) -> DataFrame:
    """key, word, n: a word's keys as the shorter (or an equally long) of two near words if `own`, else as either."""

    def keys(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and keys. A key is made of the bigram, all on its one side, and all but one piece of the shorter word's other side."""
        n, size = codes.shape
        sums = np.zeros((n, size + 1), dtype=np.uint64)  # polynomial hashes of the beginnings
        powers = np.ones(size + 1, dtype=np.uint64)
        for i in range(size):
            sums[:, i + 1] = sums[:, i] * _BASE + codes[:, i] + np.uint64(1)
            powers[i + 1] = powers[i] * _BASE

        def part(row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return sums[row, b] - sums[row, a] * powers[b - a]

        grams, every = _bigrams(codes), np.arange(n)
        # rarest first, equal ones by bigram and then by place (the sort is stable)
        order = np.argsort((rank[grams] << 16) + grams, axis=1, kind="stable")[:, :RAREST]
        zero, full = np.zeros(n, dtype=np.int64), np.full(n, size, dtype=np.int64)
        for place in order.T:
            for side, (a, b, start, end) in enumerate(((zero, place + 2, place + 2, full), (place, full, zero, place))):
                same = part(every, a, b)
                for shorter in (end - start,) if own else (end - start, end - start - 1):
                    pieces = np.clip(-(-shorter // PIECE), 1, PIECES)
                    for j in range(int(pieces.max())):
                        row = np.flatnonzero((shorter >= 0) & (pieces > j))
                        rest, k = shorter[row], pieces[row]
                        before = part(row, start[row], start[row] + rest * j // k)
                        after = part(row, end[row] - (rest - rest * (j + 1) // k), end[row])
                        tag = ((rest * PIECES + j) * 2 + side).astype(np.uint64)
                        key = (((same[row] * _MIX ^ before) * _MIX ^ after) * _BASE + tag) * _MIX
                        yield row, key ^ (key >> np.uint64(29))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches, 5000):
            for at, codes in _by_length(batch.column("word")):
                with np.errstate(over="ignore"):
                    made = [(at[i], k) for i, k in keys(codes)] if codes.shape[1] > RAREST else []
                if made:
                    rows = pa.array(np.concatenate([x for x, _ in made]))
                    key = np.concatenate([x for _, x in made]).view(np.int64)
                    yield {"key": pa.array(key), "word": batch.column("word").take(rows), "n": batch.column("n").take(rows)}

    return found.select("word", "n").mapInArrow(in_order(["key", "word", "n"], body), "key long, word string, n long")


def near(found: DataFrame) -> DataFrame:
    """word, other, n: every ordered pair of words that differ by exactly one letter, and the other's count.

    `found` has distinct words (of more than RAREST letters, else they have no near word here) and counts.
    It is read several times, so it should be a written table.
    """
    rank = frequencies(found)
    shorter, either = _keys(found, rank, own=True), _keys(found, rank, own=False)
    a, b = shorter.select("key", F.col("word").alias("a"), F.col("n").alias("an")), either.select("key", F.col("word").alias("b"), F.col("n").alias("bn"))
    pairs = a.join(b, "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    pair = lambda x, y, n: F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(n).alias("n"))
    both = F.inline(F.array(pair("a", "b", "bn"), pair("b", "a", "an")))
    return pairs.select(both).dropDuplicates(["word", "other"])


def variants(found: DataFrame, *, ratio: int = 10) -> DataFrame:
    """word, n, form, root, n_near, form_n for distinct words and their counts.

    A word's form is its near word of the largest n (ties: the smallest in code-point order) if
    that n is at least ratio times its own; else null, like form_n. The root is what following
    forms ends at, the word itself without a form; n_near counts near words. Null words are left
    out; no words give no rows.

    Each step multiplies n by ratio, so forms are followed in a number of doublings that the
    largest n gives. Only words that have a form take part in these joins.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, else forms could lead in circles")
    table = written(found.select(F.col("word").cast("string"), F.col("n").cast("long")).where("word is not null"), "words")
    best = near(table).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    joined = table.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"),
    )
    has = F.col("other_n") >= ratio * F.col("n")
    forms = written(joined.select("word", "n", F.when(has, F.col("other")).alias("form"), "n_near", F.when(has, F.col("other_n")).alias("form_n")), "forms")
    dropped(table)
    most = forms.agg(F.max("n")).first()[0] or 1
    steps = math.log(most, ratio)  # of a chain of forms at most
    links = forms.where("form is not null").select("word", F.col("form").alias("to"))
    for _ in range(math.ceil(math.log2(max(1, steps)))):
        onward = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
        links = links.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"))
    return forms.join(links, "word", "left").select("word", "n", "form", F.coalesce("to", "word").alias("root"), "n_near", "form_n")
