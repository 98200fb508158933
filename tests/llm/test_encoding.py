import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumora.llm import encoding

SIGNS = [
    " ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "ß", "漢字", "the,", "Of.", "1", "23", "'s", "'", "!", "...", "½", "²", "　", "\xa0", "\x85", "\x1c", " ",
    "<|endoftext|>", "😀", "\r\n", "don't", "́", " the", "\nThe",
]


@pytest.mark.parametrize("name, n, literal", [("byte_bpe_50k.json", 3000, False), ("byte_bpe_50k.json", 1000, True), ("word_bpe_49k.json", 200, False)])
def test_same_ids_as_the_library(name, n, literal, monkeypatch):
    monkeypatch.setattr(encoding, "KEPT", 50)
    monkeypatch.setattr(encoding, "PIECES_KEPT", 20)  # memos are emptied again and again
    path = public_tokenizers.path(name)
    own, whole = encoding.Encoder(path, literal=literal), Tokenizer.from_file(path)
    whole.encode_special_tokens = literal  # False is the library's default
    r = random.Random(3)
    for _ in range(n):
        text = "".join(r.choices(SIGNS, k=r.randint(0, 9)))
        want = np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert own.encode(text) == want, text


def test_added_tokens_have_their_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = lambda text, **more: np.frombuffer(encoding.Encoder(path, **more).encode(text), dtype="<u4").tolist()
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275] and ids("<|endoftext|>") == [50256]
    assert 50256 not in ids("a <|endoftext|> b", literal=True) and 50256 not in ids("<|endoftext|")


def test_every_code_point():
    """Each sign between letters, after a blank and doubled, so that a new version of the library cannot drift unseen."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, whole = encoding.Encoder(path), Tokenizer.from_file(path)
    signs = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    texts = ["".join(f"a{c}b {c}{c}\n" for c in signs[i : i + 64]) for i in range(0, len(signs), 64)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == want.ids, hex(ord(text[1]))


def test_many_texts_at_once():
    """Ids and lengths of a batch are the library's with the end id after each text, whatever the memo still holds."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, whole, r = encoding.Encoder(path, 50), Tokenizer.from_file(path), random.Random(4)
    signs = [*SIGNS, *[" "] * 8, "a.", "b,c", "x.y", "..", ",.", "z?!", " ?", "e\u0301.", "1.5", "a:b", "'s.", "it's,", "w$$$", "\r", ".\n"]
    batches = [["".join(r.choices(signs, k=r.randint(0, 12))) for _ in range(50)] + [None, ""] for _ in range(60)]
    codes = [chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000]
    every = [f"a{c}b {c} {c}.a {c}{c},\n{c}x. a{c}" for c in codes]
    for texts in [*batches, [None], ["one"], *(every[i : i + 50_000] for i in range(0, len(every), 50_000))]:
        ids, n = own.encode_all(pa.array(texts, pa.string()), 7)
        want = [[*x.ids, 7] for x in whole.encode_batch([x or "" for x in texts], add_special_tokens=False)]
        assert n.tolist() == [len(x) for x in want]
        assert ids.tolist() == [x for ids in want for x in ids]


def test_words_are_merged_once_for_a_batch():
    """A word is merged once for all texts of a batch, whatever sign follows it and however few the memo keeps."""
    own, merged = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 5), []
    make = own.merged
    own.merged = lambda pieces: merged.extend(pieces) or make(pieces)
    words = [f"{a}{b}" for a in ("kor", "mun", "tel", "sav") for b in ("ane", "ilo", "ush")]
    r = random.Random(1)
    texts = ["First " + " ".join(r.choice(words) + r.choice(["", ".", ",", "$$$"]) for _ in range(200)) for _ in range(20)]
    own.encode_all(pa.array(texts), 0)
    assert sorted(merged) == sorted(f" {x}" for x in [*words, "First"])


def test_slices_are_bounded_by_bytes():
    texts = ["x" * 10] * 7 + [None, "", "y" * 1000, "z"] + ["x" * 30] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    found = [x.column(0).to_pylist() for x in encoding.slices(batch.slice(1), size=40)]
    assert [x for y in found for x in y] == texts[1:]
    assert all(sum(len(x or "") for x in y[1:]) < 40 for y in found)
    assert not list(encoding.slices(batch.slice(0, 0)))
