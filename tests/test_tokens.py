"""Tokenizers over Arrow batches against their own library, and engine settings that use one."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.functions import tokens as K
from graphloom.operators import chunking
from graphloom.plans import retrieval
from graphloom.plans.engine import Config

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
TEXTS = [None, "", " ", "plain words, twice: plain words", "ünïcode und Zeichen — 日本語テキスト", "one. two. three! four? five\nsix " * 40, "x" * 30000]


def letters() -> K.Tokenizer:
    return K.Tokenizer("letters", lambda: ((lambda texts: [[ord(c) for c in t] for t in texts]), (lambda ids: ["".join(map(chr, i)) for i in ids])))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string")


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files")
def test_windows_and_sizes_against_the_library(spark, docs):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    t = K.json_vocabulary(VOCABULARY)
    ids = [library.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    got = {r.doc_id: r for r in docs.select("doc_id", K.token_ids(F.col("content"), t).alias("ids"), K.size_by(t)(F.col("content")).alias("n")).collect()}
    assert all(got[i].ids == want and got[i].n == len(want) for i, want in enumerate(ids))
    rows = chunking.token_windows(docs, 50, 8, t).orderBy("doc_id", "chunk_order_index").collect()
    want = [(d, n, len(w[a : a + 50]), library.decode(w[a : a + 50], skip_special_tokens=False).strip()) for d, w in enumerate(ids) for n, a in enumerate(range(0, len(w), 42))]
    assert [tuple(r) for r in rows] == want
    assert chunking.token_windows(docs.limit(0), 50, 8, t).count() == 0


def test_separators_in_ids_are_those_in_characters(docs):
    """A tokenizer of single characters cuts as characters do."""
    order = ["doc_id", "chunk_order_index"]
    plain, coded = (chunking.separator_chunks(docs, 60, 7, tokenizer=t).orderBy(*order).collect() for t in (None, letters()))
    assert plain == coded and len(plain) > 20


def test_budgets_count_by_the_tokenizer(spark):
    hits = spark.createDataFrame([(f"c{i}", i) for i in range(4)], "chunk_id string, ord int")
    chunks = spark.createDataFrame([(f"c{i}", "two words") for i in range(4)], "chunk_id string, content string")
    parts = lambda size, budget: len(retrieval.naive_context(hits, chunks, budget, size).first()["context"].split("--New Chunk--\n"))
    assert parts(K.size_by(None), 9) == 3  # words: 3 a chunk
    assert parts(K.size_by(letters()), 21) == 2  # characters: 10 a chunk


def test_a_tokenizer_is_part_of_the_configuration():
    plain, coded = Config(), Config(tokenizer=letters())
    assert plain.facts_hash() == Config(tokenizer=None).facts_hash() != coded.facts_hash()
    assert coded.facts_hash() == Config(tokenizer=letters()).facts_hash()
    assert "at 0x" not in repr(coded.tokenizer)
