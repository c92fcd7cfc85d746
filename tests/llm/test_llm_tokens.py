"""Byte-level BPE and token counts against their libraries, by plain functions and as operators."""

import base64
import hashlib
import tracemalloc

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from strandlake.llm import byte_bpe, token_counts
from strandlake.llm.queries import BPE_RANKS, PIECE_MODEL

RANKS = public_tokenizers.path(BPE_RANKS)
MODEL = public_tokenizers.path(PIECE_MODEL)
TEXTS = [None, "", " ", "\n", "  a", "it's we'll 's '' 'sam ''s", "a \n\n b\t", "don't 12½3 ☃☃ x", "é　中文 مرحبا", "<|endoftext|> <s>▁▁x", "x" * 3000, " ".join(["word"] * 3000), "a\x00b\x1c\x85c"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(texts):
    return [x[0].tolist() for x in byte_bpe.encode_texts(texts, RANKS)]


def test_bpe_ids_are_the_librarys(library):
    assert ids(TEXTS) == [library.encode_ordinary(t or "") for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t'strevlmdaA1.,é中▁")), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_bpe_on_any_texts(texts):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = test_bpe_on_any_texts.enc = getattr(test_bpe_on_any_texts, "enc", None) or tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids(texts) == [enc.encode_ordinary(t) for t in texts]


def test_offsets_and_decoding():
    r = byte_bpe.ranks_at(RANKS)
    for t, (i, o) in zip(TEXTS, byte_bpe.encode_texts(TEXTS, RANKS)):
        raw = (t or "").encode()
        assert r.decode(i.tolist()) == raw and o[-1] == len(raw)
        assert all(r.bytes_of[k] == raw[a:b] for k, a, b in zip(i.tolist(), o, o[1:]))


def test_long_and_short_merging_agree():
    r = byte_bpe.ranks_at(RANKS)
    for piece in (b"internationalisation", b"aaaaaaaaaaaaaaaaaaaaaaa", "überverständlichkeit".encode(), bytes(range(200, 255))):
        assert r.merged(piece) == r.merged_long(piece) == [r.ranks[p] for p in r.plain(piece)]


def test_slices_merged_together_do_not_depend_on_what_is_kept(library, monkeypatch):
    texts = [*TEXTS, *(" ".join(f"wörd{i * k}x{k}" for i in range(40)) + "abc中" * k for k in range(40)), None, " ".join("ab" * k for k in range(60))] * 2
    want = [library.encode_ordinary(t or "") for t in texts]
    for kept, wide, together in ((1, 64, 3), (100, 8, 1000), (100_000, 1, 1)):
        for name, value in (("KEPT", kept), ("WIDE", wide), ("TOGETHER", together), ("CHUNK", 500)):
            monkeypatch.setattr(byte_bpe, name, value)
        byte_bpe.ranks_at.cache_clear()
        assert ids(texts) == want


def test_what_a_worker_keeps_is_small():
    """Workers outlive their tasks and the next operator has the same memory."""
    path = byte_bpe.resolve(BPE_RANKS)
    byte_bpe.ranks_at.cache_clear()
    tracemalloc.start()
    try:
        for k in range(0, 160_000, 4_000):
            for _ in byte_bpe.encode_texts([" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}qx" for i in range(k, k + 4_000))], path):
                pass
        assert tracemalloc.get_traced_memory()[0] < 60e6
    finally:
        tracemalloc.stop()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tabcdetr▁1é中")), st.characters(codec="utf-8")), max_size=40), max_size=6))
def test_counts_on_any_texts(texts):
    sp = test_counts_on_any_texts.sp = getattr(test_counts_on_any_texts, "sp", None) or sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert token_counts.count_texts(token_counts.transducer_at(MODEL), texts) == [len(x) for x in sp.encode(texts)]


def test_chunks_compose(pieces, monkeypatch):
    texts = [t for t in TEXTS if t]
    monkeypatch.setattr(token_counts, "CHUNK", 5)
    assert token_counts.count_texts(token_counts.transducer_at(MODEL), texts) == [len(x) for x in pieces.encode(texts)]


def test_counts_do_not_depend_on_what_is_kept(pieces, monkeypatch):
    texts = [t for t in TEXTS if t]
    want = [len(x) for x in pieces.encode(texts)]
    for most in (1, 5, 100):
        monkeypatch.setattr(token_counts, "MOST_STATES", most)
        assert token_counts.count_texts(token_counts.from_sentencepiece(MODEL), texts) == want


def test_operators(spark, library, pieces):
    df = spark.createDataFrame([Row(doc_id=i, text=t, id="clash", n_tokens="clash") for i, t in enumerate(TEXTS + TEXTS[:3])] + [Row(doc_id=None, text="x", id="", n_tokens="")])
    got = byte_bpe.round_trip_digests(df, BPE_RANKS).collect()
    assert len(got) == df.count()
    for r in got:
        t = "x" if r.doc_id is None else ((TEXTS + TEXTS[:3])[r.doc_id] or "")
        want = library.encode_ordinary(t)
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    encoded = byte_bpe.encode(df.filter("doc_id IS NOT NULL"), BPE_RANKS)
    back = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(encoded, BPE_RANKS).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS + TEXTS[:3])}
    for r in token_counts.token_counts(df, PIECE_MODEL, limit=100).collect():
        t = "x" if r.doc_id is None else ((TEXTS + TEXTS[:3])[r.doc_id] or "")
        n = len(pieces.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)
    assert byte_bpe.round_trip_digests(df.limit(0), BPE_RANKS).count() == 0
    assert token_counts.token_counts(df.limit(0), PIECE_MODEL).count() == 0
