import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from winnow.llm import sentencepiece_bpe as B

PATH = B.model_path()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(text):
    n, ids, decoded = B.model(PATH).encoded(text)
    want = LIB.encode(text)
    assert ids.decode() == ",".join(map(str, want)) and n == len(want)
    assert decoded == LIB.decode(want) == B.model(PATH).decoded(want)


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_as_the_library(text):
    same(text)


@settings(max_examples=600, deadline=None)
@given(st.text("aabcdeeilnorst  ▁\n\té0.,", max_size=80))
def test_dense_merges_as_the_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 258), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert B.model(PATH).decoded(ids) == LIB.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "▁", " \n ", "\n\n", "a" * 3000, "ab" * 2000,
                                  " " * 40 + "a", "<s> </s> <0x41>", "\x00a"])
def test_edges(text):
    same(text)


def test_messy_rows(messy, empty):
    rows = messy.drop("n_tokens")
    got = B.encode(rows, PATH, outputs=("n_tokens", "ids", "decoded", "ids_sha256",
                                        "decoded_sha256"))
    assert got.columns[:len(rows.columns)] == rows.columns
    for r in got.collect():
        want = LIB.encode(r.text or "")
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == LIB.decode(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    again = B.decode(got.drop("decoded"), PATH)
    assert all(r.decoded == LIB.decode(r.ids) for r in again.collect())
    assert B.encode(empty.drop("n_tokens"), PATH).count() == 0
    with pytest.raises(ValueError):
        B.encode(messy, PATH)


def test_small_tables_change_nothing(monkeypatch):
    monkeypatch.setattr(B, "WORDS_KEPT", 2)
    monkeypatch.setattr(B, "PAIRS_KEPT", 2)
    m = B.MergeModel(PATH)
    text = "the theatre of the other mother in another weather"
    assert m.encoded(text)[1].decode() == ",".join(map(str, LIB.encode(text)))
