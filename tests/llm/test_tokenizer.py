import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import trie_tokenizer as tt

RANKS = tt.load_ranks(tt.VOCABULARY)
ENCODER = tt.TrieEncoder(RANKS)
REAL = tiktoken.Encoding("own", pat_str=tt.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = [None, "", " ", "\n\n  \t", "Hello  world !", "<|endoftext|>", "日本語の文章。", "สวัสดี", "नमस्ते दुनिया", "مرحبا", "👩‍👩‍👧 x​y", "a" * 5000, "don't they'LL 12345678901", "\x00\x01", "ß" * 300]


def encode(words):
    return dict(ENCODER.encode([w.encode() for w in words]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=8))
def test_words_like_the_definition(words):
    got = encode(set(words) - {""})
    for w, ids in got.items():
        assert ids == ENCODER.merge(w)
        assert b"".join(ENCODER.bytes_of[i] for i in ids) == w


def test_shared_prefixes():
    words = ["in", "inter", "international", "internationalisation", "internet", "i", "zoo", "zoology"]
    random.shuffle(words)
    assert encode(words) == {w.encode(): REAL.encode_ordinary(w) for w in words}


@pytest.mark.parametrize("window", [1, 1_000_000])
def test_texts(spark, window):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + [(None, "a b", "z"), (0, "again", "z")], "doc_id bigint, text string, ids string")
    rows = [(r.doc_id, r.ids) for r in tt.encode_texts(df, window=window).collect()]
    want = [(i, REAL.encode_ordinary(t) if t else []) for i, t in enumerate(TEXTS)] + [(None, REAL.encode_ordinary("a b")), (0, REAL.encode_ordinary("again"))]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert tt.encode_texts(df.limit(0)).count() == 0


def test_all_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in tt.encode_texts(docs).collect()}
    assert got == {i: REAL.encode_ordinary(t) if t else [] for i, t in texts.items()}
