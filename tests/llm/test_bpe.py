import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import bpe as B

RAW = open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RAW), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return B.Codec(RAW, P.PATTERN)


def same(codec, library, texts):
    got = codec.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode_ordinary(t or "") for t in texts]
    assert codec.decode(got) == [(t or "").encode() for t in texts]


def test_odd_texts(codec, library):
    same(codec, library, [None, "", " ", "\n\n  x", "<|endoftext|>", "it's I'LL we've", "ab" * 900, "x" * 30_000, " " * 5_000 + "a", "!" * 2_000, "日本語テキスト" * 200, "\U0001f600é\x00\x1c\x85 z"])
    same(codec, library, [])
    with pytest.raises(ValueError):
        codec.decode([np.array([60_000], "<u4").tobytes()])


def test_every_character_class(codec, library):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    same(codec, library, [f"a{c}b {c} 1{c}\n{c}{c}" for c in chars])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    same(B._codec(RAW, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(RAW), special_tokens={}), texts)


def test_heap_and_query_agree(codec):
    words = ["therethere", "aaaaabaaab", "keitheitungsch", "ñandúñandú", "xyzzyxyzzy"]
    assert [codec._contract_long(w.encode()) for w in words] == codec._contract([w.encode() for w in words])


def test_query(spark, data, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    rows = B.op10_byte_bpe(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a", 6), (1, "a", 7)], "doc_id long, text string, ids long")
    rows = B.round_trip(df).collect()
    assert sorted(bytes(r.decoded) for r in rows) == [b"", b"a", b"a"]
    assert sorted(map(str, B.decode(B.encode(df)).collect())) == sorted(map(str, rows))
    assert B.round_trip(df.limit(0)).collect() == []


def test_words_that_are_forgotten(codec, library, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 10)
    texts = [f"some thinerword{k} and re{k % 3}occurring ones" for k in range(40)]
    for k in range(0, 40, 4):
        same(codec, library, texts[k : k + 4])
