import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

tokens = pytest.importorskip("wardline.llm.tokens")
P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ours():
    return tokens.encoder(tokens.vocabulary_path(), P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text(ours, theirs, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_hard_texts(ours, theirs):
    r = random.Random(5)
    texts = ["a" * 30_000, " " * 20_000, "ab" * 9000, "<|endoftext|>", "가" * 500, "\r\n \t\n  x", "é" * 50, "\x00﻿", "aaaa aaab"]
    texts += ["".join(r.choices("ath eionrs'.,01\n", k=400)) for _ in range(200)]
    assert [ours.encode(t) for t in texts] == [theirs.encode_ordinary(t) for t in texts]


def test_table(spark, theirs):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, "", None), (3, None, "y"), (4, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").withColumn("tokens", F.lit("old"))
    got = sorted((r.doc_id, r.ids, r.tokens) for r in tokens.token_ids(df).collect())
    hello = theirs.encode_ordinary("hello world")
    assert got == [(1, hello, "old"), (1, hello, "old"), (2, [], "old"), (3, [], "old"), (4, theirs.encode_ordinary(" "), "old")]
    counted = tokens.token_counts(df)
    assert sorted((r.doc_id, r.tokens) for r in counted.collect()) == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 1)] and "text" not in counted.columns
    assert tokens.token_ids(df.where("false")).count() == 0
