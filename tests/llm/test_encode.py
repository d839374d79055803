"""Token ids against the public library."""

import base64

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import encode

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENC = tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=encode.load(), special_tokens={})
E = encode.Encoder()


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    assert E.encode(text) == ENC.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 'st\n\t1你好，。ü<|>endoftx"))
def test_mixed(text):
    assert E.encode(text) == ENC.encode_ordinary(text)


def test_long_and_special():
    for text in ("字" * 50_000, "a" * 50_000, "<|endoftext|>", "   \n  x", "don't 'll 'LL"):
        assert E.encode(text) == ENC.encode_ordinary(text)
    assert ENC.decode(E.encode("鞋码 größe")) == "鞋码 größe"
    assert base64.b64encode(b"a")


def test_operator(spark):
    df = spark.createDataFrame([(1, "shoe 鞋", "x"), (2, None, "x"), (3, "", None)], "doc_id long, text string, source string")
    assert {r.doc_id: r.ids for r in encode.ids(df).collect()} == {1: ENC.encode_ordinary("shoe 鞋"), 2: [], 3: []}
    assert [r.doc_id for r in encode.counts(df).collect()] == [1]
    assert encode.ids(df.limit(0)).count() == 0
