from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from annalist.llm import bpe, pieces

PATH = bpe.file_path(pieces.MODEL)
LIBRARY = SentencePieceProcessor(model_file=PATH)
ENCODER = pieces.encoder(PATH)
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdeinorst  ▁'.,-!1é中\n\t\0日本語")), max_size=80)


def encoded(texts, encoder=ENCODER):
    """(ids, decoded bytes) of each text."""
    spelled = [t.encode() for t in texts]
    ids, counts = encoder.encode_slice(np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)]))
    data, offsets = encoder.decode_slice(ids, counts)
    ends = np.cumsum([0, *counts])
    return [(ids[ends[i] : ends[i + 1]].tolist(), data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(len(texts))]


def from_library(text):
    ids = LIBRARY.encode(text)
    return ids, LIBRARY.decode(ids).encode()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_equals_library(texts):
    assert encoded(texts) == [from_library(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text("abcdeinrst▁", min_size=1, max_size=300))
def test_long_words_by_rounds_and_by_heap(word):
    symbols = ENCODER.symbol[np.array([ord(c) for c in word])]
    flat, counts = ENCODER.merge(symbols, np.array([len(word)]))
    assert flat.tolist() == ENCODER.merge_long(symbols.tolist()) and counts.tolist() == [len(flat)]


@pytest.mark.parametrize("text", [" " * n for n in (1, 2, 3, 17, 33, 5000)] + ["ab" * 5000, "x" * 20000, "中文" * 3000, "▁ ▁▁  x", "!▁▁▁  o", " \n" * 300, "\0\x7f�"])
def test_runs(text):
    assert encoded([text, "", text]) == [from_library(text), ([], b""), from_library(text)]


def test_pairs_of_one_rank_that_touch():
    """Overlapping, repeated and mutually stale pairs, many words at once."""
    texts = ["aaaa" * k + "bbb" * (k % 4) + "e" * k for k in range(1, 60)] + ["lalalala" * k for k in range(1, 20)]
    assert encoded(texts) == [from_library(t) for t in texts]


def test_full_store_drops_words_never_results(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 40)
    monkeypatch.setattr(bpe, "CACHE", 40)
    small = pieces.PieceBPE(PATH)
    for k in range(20):
        texts = [f"often again x{k}y {'long' * (k % 5 + 4)} " + " ".join("abcdefgh"[i % 8] * (i % 30) + str(i * k) for i in range(20)) for _ in range(2)]
        assert encoded(texts, small) == [from_library(t) for t in texts]
    assert small.table.n < 1000


def test_decoding_of_any_ids():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = rng.integers(3, 32000, 12).tolist()
        assert ENCODER.decode(ids).decode() == LIBRARY.decode(ids)
    assert ENCODER.decode([3 + 0xE4, 3 + 0xB8, 3 + 0xAD]) == "中".encode() and ENCODER.decode([]) == b""
    assert ENCODER.decode([3 + 0xFF, 3 + 0x41]).decode() == LIBRARY.decode([3 + 0xFF, 3 + 0x41])


def test_rows(docs, empty):
    """Nulls, empty and long texts, repeated rows and columns named like the operator's own."""
    clash = docs.withColumnsRenamed({"source": "ids", "index": "n_tokens", "lang": "ids_sha256"})
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.encoding_digests(clash).collect())
    want = []
    for r in docs.collect():
        ids, decoded = from_library(r.text or "")
        want.append((r.doc_id or 0, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(decoded).hexdigest()))
    assert got == sorted(want)
    assert pieces.encoding_digests(empty).count() == 0
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs.where("doc_id in (8, 14)"))).collect()} == {r.doc_id: r.text for r in docs.where("doc_id in (8, 14)").collect()}
