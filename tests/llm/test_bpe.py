import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import bpe

from . import fixtures

RANKS = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENC, DECIMALS = bpe.TextEncoder(RANKS, P.PATTERN), bpe.Decimals(RANKS)


def ids(enc, text):
    out = np.frombuffer(enc.encode(text), "<u4")
    assert DECIMALS.write(out).decode() == " ".join(map(str, out.tolist()))
    return out.tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(st.sampled_from("etaoin sh rdlu\n\t é'ßSTREÜ-=_.0123"), max_size=80), st.text(st.sampled_from("a -="), max_size=200), st.text(st.sampled_from("a1 \n."), max_size=60)))
def test_equals_the_library(text):
    assert ids(ENC, text) == LIB.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(sorted(RANKS)[::97]), max_size=6), st.binary(max_size=6))
def test_any_bytes_equal_merging(parts, tail):
    data = b"".join(parts) + tail
    if data and data not in RANKS:
        assert ENC.fst.encode(data) == ENC.fst.merge(data)


def test_table_of_bounded_size():
    enc = bpe.TextEncoder(RANKS, P.PATTERN, memo_words=3)
    enc.fst.max_transitions = 50
    text = "Words of every kind, uncharacteristically transmogrified antidisestablishmentarianism. " * 3
    assert ids(enc, text) == LIB.encode_ordinary(text) and len(enc.fst.next) < 200


def test_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in bpe.encode_documents(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for r in rows.collect():
        want = LIB.encode_ordinary(r.text)
        g = got[r.doc_id]
        assert g.n_tokens == len(want) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_odd_rows(spark):
    got = bpe.encode_documents(fixtures.odd(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    want = [(d, len(LIB.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in fixtures.odd_rows()]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(fixtures.none(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20), st.lists(st.integers(0, 60), max_size=5))
def test_streaming_utf8(text, cuts):
    data, machine, out, at = text.encode(), bpe.Utf8Machine(), "", 0
    for c in sorted(cuts) + [len(data)]:
        out += machine.feed(data[at:c])
        at = max(at, c)
    assert out + machine.end() == text


@pytest.mark.parametrize("data", [b"\xff\xfe", b"a\xe2\x82", b"\xf0\x9f\x98", b"\xc3", b"\x80\x80"])
def test_streaming_broken_utf8(data):
    machine = bpe.Utf8Machine()
    assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.end() == data.decode("utf-8", "replace")
