"""Token ids of whole texts by the tokenizers library, with what was encoded before kept in the worker."""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from lumora.llm.shared import RELEASE, Memo

#: Remembered words and pieces of words for each generation of a memo; two generations are held.
KEPT, PIECES_KEPT = 300_000, 60_000

#: How byte-level vocabularies split a text before the merges (fixed value).
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: White space (fixed value), and the runs between which no piece reaches: a word with its space, or white space.
_WIDE = "\x85\xa0  -     　"
_SPACE = f"\t-\r {_WIDE}"
RUNS = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: More than a blank or a line end between words, or either at an end of the text: such texts are split by RUNS.
ODD = f"  | \n|\n |\n\n|^[ \n]|[ \n]$|[\t\x0b-\r{_WIDE}]"
#: A sign after a letter (but an apostrophe) begins a piece, so it is parted from its word, by a mark that no text split at blanks has.
SIGN, MARK = r"(\pL)([!-&(-/:-@[-`{-~])", "\r"


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


class Encoder:
    """encode(text): the ids as bytes, little-endian unsigned 32-bit; encode_all(texts): those of many texts.

    The ids are those of the library's encode(text, add_special_tokens=False): an added
    token's string in a text has that token's id, unless `literal`, which makes special
    tokens' strings ordinary text. A byte-level vocabulary splits a text into pieces that
    are merged one by one, so equal pieces are encoded once, and words that many texts of a batch
    have are looked up once. Other vocabularies encode each whole text.
    """

    def __init__(self, path: str, kept: int | None = None, literal: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = [x for x in spec.get("added_tokens") or [] if not (literal and x["special"])]
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and spec["model"]["type"] == "BPE"
            and not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        )
        self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in added}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest)})")
        self.odd = "|".join([ODD, *longest])
        signs = byte_signs()
        model = self.tokenizer.model
        model._resize_cache(0)  # the memos below serve for it

        def mapped(piece: str) -> str:
            if piece.isascii() and piece.isprintable():
                return piece.replace(" ", signs[32])  # the other printable signs stand for themselves
            return piece.encode().decode("latin-1").translate(signs)

        def merged(pieces: list[str]) -> list[bytes]:
            tokenize = model.tokenize
            return [array("I", [x.id for x in tokenize(piece)]).tobytes() for piece in map(mapped, pieces)]

        def split(run: str) -> bytes:
            if run[1:].isalpha() and (run[0] == " " or run[0].isalpha()):
                return merged([run])[0]  # one piece
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(run)))

        def after_blank(word: str) -> bytes:
            """A word after a blank; a line end stands before its word and takes no blank, nor does what was parted from a word."""
            if word[:1] == "\n":
                return self.pieces["\n"] + split(word[1:])
            return split(word[1:] if word[:1] == MARK else " " + word)

        self.merged = merged
        self.pieces = Memo(lambda piece: merged([piece])[0], PIECES_KEPT)
        self.runs = Memo(split, PIECES_KEPT)
        self.words = Memo(after_blank, kept or KEPT)

    def encode(self, text: str) -> bytes:
        if not self.by_piece:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(ids, dtype="<u4").tobytes()
        if any(x in text for x in self.added):
            parts = self.cut.split(text)  # every other one is an added token
            return b"".join(self.added[x] if i % 2 else self._plain(x) for i, x in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        found = b"".join(map(self.runs.__getitem__, RUNS.findall(text)))
        self._trim()
        return found

    def _trim(self) -> None:
        self.words.trim()
        self.pieces.trim()
        self.runs.trim()

    def _after_blanks(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words after blanks: letters that are not known yet are merged in one loop."""
        known, old = self.words, self.words.old
        new = [x for x in words if x not in known]
        again = [x for x in new if x in old]
        known.update(zip(again, map(old.__getitem__, again), strict=True))
        new = [x for x in new if x.isalpha() and x not in old]
        known.update(zip(new, self.merged([" " + x for x in new]), strict=True))
        return list(map(known.__getitem__, words))

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each, and how many each has with it. Null is an empty text.

        Words are looked up once for all texts. A text's first word, which has no blank before
        it, its last word, after which end_id stands, and texts that are not words with single blanks
        or line ends between them, whole, are entries of their own.
        """
        texts, last = texts.fill_null(""), array("I", [end_id]).tobytes()
        odd = pc.match_substring_regex(texts, self.odd) if self.by_piece else pa.array([True] * len(texts))
        plain = pc.replace_substring(pc.if_else(odd, "", texts), "\n", " \n")
        split = pc.split_pattern(pc.replace_substring_regex(plain, SIGN, rf"\1 {MARK}\2"), " ")
        starts, coded = split.offsets.to_numpy(), split.values.dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        del plain, split, coded  # copies of all texts
        found = self._after_blanks(words)
        heads, tails = codes[starts[:-1]].tolist(), codes[starts[1:] - 1].tolist()
        several = np.flatnonzero(np.diff(starts) > 1)
        codes[starts[:-1]] = np.arange(len(texts)) + len(found)
        codes[starts[1:][several] - 1] = np.arange(len(several)) + len(found) + len(texts)
        ends = [found[tails[i]] + last for i in several.tolist()]
        found += [self.encode(texts[i].as_py()) if x else self.runs[words[heads[i]]] for i, x in enumerate(odd.to_pylist())]
        for i in np.flatnonzero(np.diff(starts) == 1).tolist():
            found[i - len(texts)] += last
        ids = pa.array(found + ends, pa.large_binary()).take(pa.array(codes))
        self._trim()
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[starts] // 4
        return np.frombuffer(ids.buffers()[2], dtype="<u4")[: ends[-1]], np.diff(ends)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a text and less than `size` bytes of further texts."""
    part = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64) // size
    bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in pairwise(bounds):
        if a < b:
            yield batch.slice(a, b - a)


_THRESHOLD = gc.get_threshold()


@lru_cache(maxsize=1)
def encoder(path: str, kept: int | None = None, literal: bool = False) -> Encoder:
    """The worker's own encoder, which lives as long as no other operator needs the worker.

    It makes very many strings and no cycles, so the worker looks for cycles less often.
    """
    gc.set_threshold(200_000, 20, 20)
    return Encoder(path, kept, literal)


def _forget() -> None:
    encoder.cache_clear()
    gc.set_threshold(*_THRESHOLD)


RELEASE["encoder"] = _forget
