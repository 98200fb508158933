import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumora.llm import counting, queries
from tests.conftest import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")


def slow(texts):
    own = Tokenizer.from_file(PATH)
    return [len(own.encode(x or "", add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("block", [500, 1 << 20])
def test_counts_awkward(spark, awkward, block):
    odd = [
        "a<|endoftext|>b <|startoftext|><|STARTOFTEXT|> <|endoftext|", "it's we'll THEY'RE 'S 's", "é ́e İİ ΑΣ Σ", "a\tb\r\nc\x85d\xa0e f\x1cg​h",
        "12345 ½ ٣", "漢字かな😀👍🏽", "≮ |>", " \n ", "\n\nx  y\n", "x\x00y \x00", "﻿a b", "don't<|endoftext|>'s", "ﬁ Ａ ǅ", "z" * 5000,
    ]
    r = random.Random(3)
    signs = [*"aZé'’ \n\t.,<|>019́漢", "<|endoftext|>", "  ", "'ll", " "]
    odd += ["".join(r.choices(signs, k=r.randint(1, 60))) for _ in range(150)]
    extra = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").unionByName(extra).withColumnsRenamed({}).selectExpr("*", "doc_id as id", "text as words", "doc_id as block").repartition(3)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(((x.doc_id, x.n_bytes, x.n_tokens) for x in counting.count(docs, tokenizer=PATH, block=block).collect()), key=repr)
    want = sorted(((i, len((x or "").encode()), n) for (i, x), n in zip(rows, slow([x for _, x in rows]), strict=True)), key=repr)
    assert got == want


def test_empty_table_and_other_vocabularies(spark, awkward):
    assert counting.count(awkward.limit(0), tokenizer=PATH).count() == 0
    with pytest.raises(ValueError):
        counting.PreTokens(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark):
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: (n, n > 2048) for r, n in zip(rows, slow([r.text for r in rows]), strict=True)}
