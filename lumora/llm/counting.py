"""Token counts of whole texts: pieces are counted once for each distinct pre-token of the corpus.

Texts are taken in blocks. A block's documents keep how often each has each of the block's
pre-tokens, by number; the block's pre-tokens are joined to the counts of pieces of the
distinct ones, and the counts return to the block, where they are multiplied and summed.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumora.llm.encoding import byte_signs
from lumora.llm.shared import RELEASE, Memo, in_order, narrowed, sliced, written

#: Bytes of text in a block. A longer text is a block of its own.
BLOCK = 16 << 20
#: Before a run that is counted whole, as it holds an added token's string; no pre-token has this sign.
WHOLE = "\0"
#: Runs of printable signs of ASCII and of Latin letters before the combining ones: normal forms leave them as they are.
PLAIN = re.compile("[!-~\u00a1-\u024f]+")


class PreTokens:
    """split(run): the pre-tokens of what stands between two blanks; pieces(x): how many pieces one has.

    For vocabularies of the tokenizers library whose pre-tokens end at blanks and do not hold
    them: white space is dropped, and nothing before that looks beyond it. Others are refused.
    A run with an added token's string is kept whole, for the library to encode as it does by default.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = lambda x, inner: x.get(inner, [x]) if x else []
        normal, split = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
        added = [x["content"] for x in spec["added_tokens"]]
        if not (
            split and split[0]["type"] == "Split" and split[0]["behavior"] == "Removed" and split[0]["invert"]
            and all(x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or x["type"] == "Replace" and x["content"] == " " for x in normal)
            and not any(" " in x or "\n" in x for x in added)
            and not self.tokenizer.pre_tokenizer.pre_tokenize_str(" \n")
        ):
            raise ValueError("pre-tokens of this vocabulary do not end at blanks")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model

        #: the split as a pattern, where the steps are known: what it finds, byte by byte
        plain = all(x["type"] != "Replace" or x["pattern"] == {"Regex": r"\s+"} for x in normal) and len(split) == 2 and "Regex" in split[0]["pattern"]
        plain = plain and split[1]["type"] == "ByteLevel" and not split[1]["use_regex"] and not split[1]["add_prefix_space"]
        pattern = regex.compile(split[0]["pattern"]["Regex"]) if plain else None
        lower, signs = any(x["type"] == "Lowercase" for x in normal), byte_signs()

        special = re.compile("|".join(map(re.escape, added)) or r"(?!)").search

        def split(run: str) -> list[str]:
            plain = pattern and PLAIN.fullmatch(run)
            normalized = (run.lower() if lower else run) if plain else self.tokenizer.normalizer.normalize_str(run) if self.tokenizer.normalizer else run
            if special(run) or special(normalized):
                return [WHOLE + run]
            if plain:
                found = pattern.findall(normalized)
                return found if normalized.isascii() else [x.encode().decode("latin-1").translate(signs) for x in found]
            return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normalized)]

        self.split = split

    def pieces(self, pre_token: str) -> int:
        if pre_token.startswith(WHOLE):
            return len(self.tokenizer.encode(pre_token[1:], add_special_tokens=False).ids)
        return len(self.model.tokenize(pre_token))


@lru_cache(maxsize=1)
def pre_tokens(path: str) -> PreTokens:
    """The worker's own, as long as no other operator needs the worker."""
    return PreTokens(path)


RELEASE["pre-tokens"] = pre_tokens.cache_clear

_COLUMNS = ["block", "id", "n_bytes", "once", "more", "times", "words"]
_BLOCKS = "block long, id long, n_bytes long, once binary, more binary, times binary, words array<string>"


def _blocks(rows: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """A row for each document: numbers of the pre-tokens that it has once and more often, and how often; and one of the block's pre-tokens."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, part, done = pre_tokens(tokenizer), TaskContext.get().partitionId() << 32, 0
        block, filled = Block(own), 0

        def closed() -> dict:
            one = {"block": pa.array([part + done]), "words": pa.array([list(block.numbers)], pa.list_(pa.string()))}
            return one | {k: pa.nulls(1, pa.int64()) for k in ("id", "n_bytes")} | {k: pa.nulls(1, pa.binary()) for k in ("once", "more", "times")}

        for batch in sliced(batches, 200):
            sizes, at, found = batch.column("n_bytes").to_pylist(), 0, []
            for i, text in enumerate(batch.column("text")):
                if filled and filled + sizes[i] > size:
                    yield from documents(batch.slice(at, i - at), found, part + done)
                    yield closed()
                    block, filled, done, at, found = Block(own), 0, done + 1, i, []
                filled += sizes[i]
                found.append(block.counts(text.as_py() or ""))
            yield from documents(batch.slice(at), found, part + done)
        yield closed()

    def documents(batch: pa.RecordBatch, found: list, block: int) -> Iterator[dict]:
        if found:
            made = {k: pa.array(x, pa.binary()) for k, x in zip(("once", "more", "times"), zip(*found, strict=True), strict=True)}
            yield made | {"block": pa.array([block] * len(found), pa.int64()), "id": batch.column("id"), "n_bytes": batch.column("n_bytes"),
                          "words": pa.nulls(len(found), pa.list_(pa.string()))}

    return rows.mapInArrow(in_order(_COLUMNS, body, "pre-tokens"), _BLOCKS)


class Block:
    """The pre-tokens of a block of texts, numbered as they come, and a text's counts of them."""

    def __init__(self, own: PreTokens):
        self.numbers: dict[str, int] = {}
        self.of = array("q")  # the pre-tokens of each run of letters, one after the other
        self.ends = array("q", [0])

        def number(run: str) -> int:
            for x in own.split(run):
                self.of.append(self.numbers.setdefault(x, len(self.numbers)))
            self.ends.append(len(self.of))
            return len(self.ends) - 2

        self.runs = Memo(number, 0)

    def counts(self, text: str) -> tuple[bytes, bytes, bytes]:
        runs = Counter(text.replace("\n", " ").split(" "))
        runs.pop("", None)
        at = np.fromiter(map(self.runs.__getitem__, runs), np.int64, len(runs))
        of, ends = np.frombuffer(self.of, np.int64) if self.of else np.zeros(0, np.int64), np.frombuffer(self.ends, np.int64)
        sizes = ends[at + 1] - ends[at]
        n = np.repeat(np.fromiter(runs.values(), np.int64, len(runs)), sizes)
        place = np.repeat(ends[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(n))
        k, back = np.unique(of[place], return_inverse=True)
        n = np.bincount(back, n, len(k)).astype(np.int64)
        more = n > 1
        return packed(np.diff(k[~more], prepend=0)), packed(np.diff(k[more], prepend=0)), packed(n[more])


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 to 2**35 in as many bytes of 7 bits as each needs, the last of them under 128."""
    parts = (x[:, None] >> np.arange(0, 35, 7)) & 127
    size = 1 + sum((x >= 1 << b).astype(np.int64) for b in range(7, 35, 7))
    parts[np.arange(5) < size[:, None] - 1] |= 128
    return parts.astype(np.uint8)[np.arange(5) < size[:, None]].tobytes()


def unpacked(x: bytes) -> np.ndarray:
    a = np.frombuffer(x, np.uint8).astype(np.int64)
    start = np.flatnonzero(np.append(True, a[:-1] < 128)) if len(a) else np.zeros(0, np.int64)
    place = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return np.add.reduceat((a & 127) << 7 * place, start) if len(a) else a


def _summed(documents: pa.Table, counts: pa.Table) -> pa.Table:
    """The token counts of one block's documents."""
    pieces = np.zeros(counts.num_rows, dtype=np.int64)
    pieces[counts.column("k").to_numpy()] = counts.column("pieces").to_numpy()
    n = [
        int(pieces[np.cumsum(unpacked(once))].sum() + pieces[np.cumsum(unpacked(more))] @ unpacked(times))
        for once, more, times in zip(*(documents.column(x).to_pylist() for x in ("once", "more", "times")), strict=True)
    ]
    return pa.table({"doc_id": documents.column("id"), "n_bytes": documents.column("n_bytes"), "n_tokens": pa.array(n, pa.int64())})


def count(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row: UTF-8 bytes and the ids that the tokenizers library gives for the whole text.

    Without begin, end or added special tokens; special strings in a text count as the
    library's default has them. Null texts count as empty, null and repeated ids are rows like
    others, no rows give none.

    A block's table of pre-tokens bounds the memory, besides one text. What is shuffled
    is the distinct pre-tokens of each block, there and (as numbers) back, and one or two bytes for each distinct
    pre-token of a document; a pre-token that all texts have is one row a block.
    """
    rows = narrowed(docs, id=id_col, text=text_col)
    rows = rows.select(F.col("id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    table = written(_blocks(rows, tokenizer, block), "blocks")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The rows of each pre-token follow one another, so its pieces are counted once and joined to all of them."""
        own, last, n = pre_tokens(tokenizer), None, 0
        for batch in batches:
            pieces = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, n = word, own.pieces(word)
                pieces.append(n)
            yield {"of": batch.column("block"), "k": batch.column("k"), "pieces": pa.array(pieces, pa.int32())}

    own = table.where("words is not null").select("block", F.posexplode("words").alias("k", "word"))
    back = own.repartition("word").sortWithinPartitions("word").mapInArrow(in_order(["of", "k", "pieces"], counted, "pre-tokens"), "of long, k int, pieces int")
    documents = table.where("words is null").select("block", "id", "n_bytes", "once", "more", "times")
    return documents.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
