from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pantryline.llm import bpe, tokenfile

LIBRARY = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
PIECES = ["a", "th", "in", "ing", " ", "'s", "1", "!", "é", "ß", "the", "Qu", "\n", "zz", "Σ", "İ", "日", "👍🏽", "́", "<|endoftext|>"]
TEXTS = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PIECES), max_size=30).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_and_decoded_text_equal_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = bpe.word_bpe().encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert bpe.word_bpe().decode(got).decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_plain_characters_need_no_normal_form():
    import unicodedata

    plain = [chr(i) for i in range(0x250) if bpe.PLAIN.fullmatch(chr(i))]
    assert all(unicodedata.is_normalized("NFC", c) for c in plain)
    import regex

    letters = regex.compile(f"[{bpe.LETTERS}]")
    assert all(bool(letters.fullmatch(c)) == bool(regex.fullmatch(r"\p{L}", c)) for c in plain)
    numbers = regex.compile(f"[{bpe.NUMBERS}]")
    assert all(bool(numbers.fullmatch(c)) == bool(regex.fullmatch(r"\p{N}", c)) for c in plain)


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "WORD_CACHE", 2)
    monkeypatch.setattr(bpe, "PAIR_CACHE", 2)
    coder = bpe.WordBpe(bpe.vocabulary_path(bpe.VOCABULARY))
    text = "several different words, and several words again"
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_decoding_in_chunks():
    ids = bpe.word_bpe().encode("some words that are decoded bit by bit")
    assert bpe.word_bpe().decode(ids, chunk=2) == bpe.word_bpe().decode(ids)


def test_documents(edge_docs, no_docs):
    rows = bpe.encode_documents(edge_docs).collect()
    given_rows = edge_docs.select("doc_id", "text").collect()
    want = []
    for r in given_rows:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, raw, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    order = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted([(r.doc_id, bytes(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows], key=order) == sorted(want, key=order)
    assert bpe.encode_documents(no_docs).collect() == []


BYTE_LIBRARY = Tokenizer.from_file(bpe.vocabulary_path(tokenfile.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXTS, st.lists(st.sampled_from(["a", "th", " ", "  ", "'s", "'", "1", "!", "é", "\n", "\t", "\r\n"]), max_size=30).map("".join)))
def test_byte_ids_equal_the_library(text):
    assert np.frombuffer(tokenfile.byte_bpe().encode(text), "<u4").tolist() == BYTE_LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS, st.lists(st.sampled_from(["a", "th", " ", "the", "'s", ", ", "1", "!", "é", "\n", " x"]), max_size=30).map("".join)), max_size=6))
def test_texts_encoded_together_equal_the_library(texts):
    counts, ids = tokenfile.byte_bpe().encode_all(texts, (2).to_bytes(4, "little"))
    want = [BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_stretches_of_texts():
    texts = pa.array(["a" * n if n is not None else None for n in (3, 4, 20, None, 0, 9, 1, 1)])
    assert tokenfile._stretches(texts, 10) == [(0, 2), (2, 3), (3, 7), (7, 8)]
    assert tokenfile._stretches(texts[:0], 10) == []


def test_forgetful_caches_change_no_byte_ids():
    encoder = tokenfile.ByteBpe(tokenfile.vocabulary_path(tokenfile.VOCABULARY))
    encoder.chunks, encoder.pieces = tokenfile.Recent(3), tokenfile.Recent(2)
    text = "One, two; three! one Two? it's (three) one... ünd word, word word. don't\tthere x1 y-z one, two"
    for _ in range(3):
        for part in (text, text.swapcase(), text[::-1], text.replace(" ", "  ", 2)):
            assert encoder.encode(part) == encoder.whole(part)
    assert len(encoder.chunks.new) <= 3 and len(encoder.chunks.old) <= 3


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("high", [1, 2, 255, 1 << 17, 1 << 32])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    ids[::50] = high - 1  # outliers
    data, n_blocks, n_over = tokenfile.encode_ids(ids)
    assert (tokenfile.decode_ids(memoryview(data), n, n_blocks, n_over) == ids).all()
    if n == 1000:
        some = tokenfile.decode_ids(memoryview(data), n, n_blocks, n_over, slice(2, 4))
        assert (some == ids[256:512]).all()


def test_outliers_are_patched_and_save_bits():
    ids = np.random.default_rng(0).integers(1000, 1016, 12_800).astype(np.uint32)
    ids[::128] = 50_000
    data, _, n_over = tokenfile.encode_ids(ids)
    assert n_over == 100 and len(data) < 12_800 * 5 / 8 + 100 * 30


def test_segments_keep_null_ids():
    counts, ids = [2, 0, 1], np.array([5, 6, 7], np.uint32)
    doc_ids, got_counts, got = tokenfile.decode_segment(tokenfile.encode_segment([None, -3, 9], counts, ids))
    assert (doc_ids, got_counts.tolist(), got.tolist()) == ([None, -3, 9], counts, [5, 6, 7])


def test_token_files(spark, edge_docs, no_docs, tmp_path):
    for ranges, segment in ((1, 1 << 18), (4, 10)):
        path = str(tmp_path / f"tokens-{ranges}")
        tokenfile.write_tokens(edge_docs, path, ranges, segment_ids=segment)
        got = sorted(tokenfile.read_tokens(spark, path).collect(), key=lambda r: r.start)
        given_rows = sorted(edge_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        assert [r.doc_id for r in got] == [r.doc_id for r in given_rows]
        whole = lambda t: np.array([*BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert sorted(bytes(r.ids) for r in got) == sorted(whole(r.text) for r in given_rows)
        assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    tokenfile.write_tokens(no_docs, str(tmp_path / "none"), 3)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).collect() == []
