"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm.shared import RELEASE, binaries, in_order, narrowed, release, sliced, written

#: Bytes of items whose windows one automaton takes: about 85 times as much memory in a worker (measured), and a broadcast of
#: less than the items. Of more items only the windows that occur in the texts are kept first.
GROUP_BYTES = 4 << 20

#: A-Z in lower case; all but letters, digits and bytes of other signs become spaces.
FOLD = bytes(
    x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Windows:
    """The windows of items, a sign for each distinct word: an automaton over signs has a state for each word, not for each letter.

    lines: (item, its words as signs). A whole line is a window if it is shorter than `window`.
    """

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.window, self.lines = window, []
        signs: dict[bytes, str] = {}
        for item, text in items:
            self.lines.append((item, "".join([signs.setdefault(x, _sign(len(signs))) for x in words(text)])))
        self.vocabulary = b" ".join(signs)
        if len(signs) > 0x10F7FF:
            raise ValueError("more words than signs: choose a smaller group_bytes")

    def signs(self) -> dict[bytes, str]:
        return {x: _sign(i) for i, x in enumerate(self.vocabulary.split())}

    def each(self) -> Iterator[tuple[str, int]]:
        """Each window as signs, with its item."""
        for item, line in self.lines:
            for i in range(max(1, len(line) - self.window + 1) if line else 0):
                yield line[i : i + self.window], item


#: A word that no item has.
OTHER = "\0"


def _sign(number: int) -> str:
    """A code point for each word: all but zero and the surrogates, of which there are 1,112,063."""
    return chr(1 + number if number < 0xD7FF else 0x801 + number)


class Scanner:
    """The automaton of some Windows, built once in a worker."""

    def __init__(self, windows: Windows):
        self.signs = windows.signs()
        found: dict[str, int] = {}
        self.items: list[int | set] = []
        self.made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for window, item in windows.each():
            at = found.setdefault(window, len(found))
            if at == len(self.items):
                self.items.append(item)
                self.made.add_word(window, at * (windows.window + 1) + len(window))
            elif self.items[at] != item:  # few windows are of several items
                self.items[at] = {item} | (self.items[at] if isinstance(self.items[at], set) else {self.items[at]})
        self.width = windows.window + 1
        if found:
            self.made.make_automaton()

    def __call__(self, own: list[bytes]) -> Iterator[tuple[int, int, tuple]]:
        """Of a text's words: the last word, number of words and items of each occurrence of a window."""
        if not self.items:
            return
        get, width = self.signs.get, self.width
        for last, key in self.made.iter("".join([get(x, OTHER) for x in own])):
            items = self.items[key // width]
            yield last, key % width, tuple(items) if isinstance(items, set) else (items,)


_built: dict[str, Scanner] = {}
RELEASE["decontamination"] = _built.clear


def _scanner(key: str, windows: Windows) -> Scanner:
    if key not in _built:
        if len(_built) >= 8:
            _built.clear()
        _built[key] = Scanner(windows)
    return _built[key]


def _groups(items: DataFrame, group_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The items (item_id, text) in groups of about group_bytes bytes at most; the driver holds one group at a time."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-size // group_bytes) or 1
    for group in range(groups):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group)
        yield [(r[0], bytes(r[1])) for r in own.toLocalIterator()]


def _grouped(
    docs: DataFrame, text_col: str, items: DataFrame, item_id_col: str, item_text_col: str, window: int, group_bytes: int
) -> Iterator[tuple[Broadcast, str]]:
    """Broadcast Windows, each with a name: one, unless more than group_bytes of items' windows occur in the texts."""
    context = docs.sparkSession.sparkContext
    bench = narrowed(items, item_id=item_id_col, text=item_text_col).where("item_id is not null and text is not null")
    bench = bench.select(F.col("item_id").cast("long"), F.encode("text", "utf-8").alias("text")).distinct()
    if (bench.agg(F.sum(F.length("text"))).first()[0] or 0) > group_bytes:
        bench = _occurring(narrowed(docs, text=text_col), bench, window, group_bytes)
    for group in _groups(bench, group_bytes):
        yield context.broadcast(Windows(group, window)), uuid.uuid4().hex


def _occurring(texts: DataFrame, items: DataFrame, window: int, group_bytes: int) -> DataFrame:
    """item_id, text: each window of the items, as a text, that occurs in the texts.

    One job for each group of items, which holds that group's automaton alone, and gives
    distinct windows. For a benchmark over one automaton's bound this costs a scan for each
    group; what is left is small unless the texts hold most of the benchmark.
    """
    parts = []
    for group in _groups(items, group_bytes):
        held, key = texts.sparkSession.sparkContext.broadcast(Windows(group, window)), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], held=held, key=key) -> Iterator[dict]:
            made, seen = _scanner(key, held.value), set()
            for batch in sliced(batches):
                found = []
                for text in binaries(batch.column("text")):
                    own = words(text)
                    for last, n, items in made(own):
                        line = b" ".join(own[last - n + 1 : last + 1])
                        if line not in seen:
                            seen.add(line)
                            found += [(item, line) for item in items]
                if found:
                    yield dict(zip(("item_id", "text"), map(pa.array, zip(*found, strict=True), (pa.int64(), pa.binary())), strict=True))

        rows = texts.select(F.encode("text", "utf-8").alias("text")).mapInArrow(in_order(["item_id", "text"], scan, "decontamination"), "item_id long, text binary")
        parts.append(written(rows.distinct(), "occurring-windows"))
        held.destroy()
    return reduce(lambda a, b: a.unionByName(b), parts)


def find(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (start, end as byte offsets in the original text), items.

    A word is hit if it lies in an occurrence of `window` consecutive words of an item; an
    item of fewer words, but not none, is one window. Each text is normalised and scanned
    once by one automaton; words found in the normalised text lead back to the
    original bytes. An automaton takes group_bytes of items; of more, first only the windows
    that occur in the texts are kept (see _occurring), and if even these are more, texts pass
    through several automata in one job. Null or empty texts have no words; items with null id or no words
    have no windows; repeated items count once; repeated documents get a row each.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long"), F.encode("text", "utf-8").alias("text"),
        F.array().cast("array<int>").alias("hits"), F.array().cast("array<long>").alias("items"),
    )
    names = ["doc_id", "text", "hits", "items"]
    for windows, key in _grouped(docs, text_col, items, item_id_col, item_text_col, window, group_bytes):

        def scan(batches: Iterator[pa.RecordBatch], windows=windows, key=key) -> Iterator[dict]:
            made = _scanner(key, windows.value)
            for batch in sliced(batches):
                hits, found = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
                for i, text in enumerate(binaries(batch.column("text"))):
                    got = list(made(words(text)))
                    if got:
                        hits[i] = hits[i] + [v for last, n, _ in got for v in (last - n + 1, last + 1)]
                        found[i] = sorted({*found[i], *(x for _, _, of in got for x in of)})
                yield {
                    "doc_id": batch.column("doc_id"), "text": batch.column("text"),
                    "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.int64())),
                }

        rows = rows.mapInArrow(in_order(names, scan, "decontamination"), "doc_id long, text binary, hits array<int>, items array<long>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches):
            n_words, n_hit, spans = [], [], []
            for text, hits in zip(binaries(batch.column("text")), batch.column("hits").to_pylist(), strict=True):
                if not hits:
                    n_words.append(len(words(text)))
                    n_hit.append(0)
                    spans.append([])
                    continue
                starts, ends = _runs(np.frombuffer(text.translate(FOLD), dtype=np.uint8) != 32)
                level = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(level, hits[::2], 1)
                np.add.at(level, hits[1::2], -1)
                hit = np.cumsum(level)[:-1] > 0
                n_words.append(len(starts))
                n_hit.append(int(hit.sum()))
                spans.append([{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(*_runs(hit), strict=True)])
            yield {
                "doc_id": batch.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "spans": pa.array(spans, span), "items": batch.column("items"),
            }

    return rows.mapInArrow(
        in_order(["doc_id", "n_words", "n_hit", "spans", "items"], merge, "decontamination"),
        "doc_id long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<long>",
    )


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def kept(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    for windows, key in _grouped(docs, text_col, items, item_id_col, item_text_col, window, group_bytes):

        def scan(batches: Iterator[pa.RecordBatch], windows=windows, key=key) -> Iterator[pa.RecordBatch]:
            release("decontamination")
            made = _scanner(key, windows.value)
            for batch in sliced(batches):
                clean = [next(made(words(x)), None) is None for x in binaries(batch.column(text_col))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
