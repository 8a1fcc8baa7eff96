"""BPE beside the tokenizers library, and exact round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shoalcount.llm import bpe

DOCS = "doc_id bigint, text string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.production_file())


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_random_texts(library):
    rng = random.Random(7)
    letters = "aeioutsrnhl ABC'sédßñ 0123\n\t.,! \x85\x1c\x1f 　中文字😀́½²_-<|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    texts += ["<|endoftext|>", "a <|endoftext|> b  ", "<|endoftext|><|endoftext|>x", "<|endo", "we'll 'S don't", " " * 500 + "a", "xyzzy" * 2000]
    with open(bpe.production_file(), encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    table = bpe.WordTable(vocabulary)
    for text, (n, ids, raw) in zip(texts, bpe.encode_texts(texts, vocabulary, table)):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, raw.decode()) == (len(want), ",".join(map(str, want)), library.decode(want, skip_special_tokens=False)), text
        assert bpe.decode_ids(want, vocabulary) == text


def test_documents(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.encode(docs, bpe.production_file()).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(library, texts[r["doc_id"]])


def test_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "one"), (3, "twice"), (3, "twice"), (4, "long text " * 40000)]
    docs = spark.createDataFrame([(*r, "n") for r in rows], DOCS)
    out = bpe.encode(docs, bpe.production_file(), keep_ids=True).collect()
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted(expected(library, t or "") for _, t in rows)
    assert [r["ids"] for r in out if r["doc_id"] == 1] == [[]]
    assert bpe.encode(docs.where(F.lit(False)), bpe.production_file()).count() == 0
