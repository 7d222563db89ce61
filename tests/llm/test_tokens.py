import json
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annalist.llm import bpe, packing, simple8b, wordpiece
from annalist.llm.common import shared_folder


def library(name):
    t = Tokenizer.from_file(bpe.file_path(name))
    t.no_padding(), t.no_truncation()
    return t


WORD = library(bpe.VOCABULARY)
ENCODER = bpe.encoder(bpe.file_path(bpe.VOCABULARY))
TEXT = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdeinorst '.,-!1é中\n<|>")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_equals_library(text):
    ids, _ = ENCODER.encode_batch([text])
    assert ids.tolist() == WORD.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.text("abcdeinrst", min_size=1, max_size=400))
def test_bpe_merges(word):
    expected = WORD.encode(word, add_special_tokens=False).ids
    letters, size = np.frombuffer(word.encode(), np.uint8).astype(np.int64), np.array([len(word)])
    tokens = [*ENCODER.base[letters[:-1]].tolist(), int(ENCODER.last[letters[-1]])]
    assert ENCODER.merge_all(letters, size)[0].tolist() == expected == ENCODER.merge_long(tokens)
    assert ENCODER.encode_words(letters, size)[0].tolist() == expected


def test_bpe_keeps_words_met_again(monkeypatch):
    """A full table drops words, never results."""
    monkeypatch.setattr(bpe, "CACHE", 60)
    monkeypatch.setattr(bpe, "PAIRS", 40)
    small = bpe.WordBPE(bpe.file_path(bpe.VOCABULARY))
    for k in range(30):
        texts = [f"often again x{k}y{k * 7} {'long' * (k % 5 + 4)} <|endoftext|>" + " ".join("abcdefgh"[i % 8] * (i % 30) + str(i * k) for i in range(20)) for _ in range(2)]
        ids, counts = small.encode_batch(texts, 1)
        want = [[*WORD.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
    assert small.table.n < 1000


def test_hashed_map():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 20000))
    some = bpe.Hashed(16)
    for part in np.array_split(keys, 7):
        some.put(part, (part % 1000).astype(np.int32))
    assert (some.get(keys) == keys % 1000).all() and (some.get(keys + (1 << 41)) == -1).all()


def test_bpe_rows(docs, empty):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoding_digests(docs).collect())
    want = []
    for r in docs.collect():
        ids = WORD.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id or 0, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(WORD.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encoding_digests(empty).count() == 0
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.where("doc_id = 8"))).collect()}
    assert texts == {8: "one</w> two</w>"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, (1 << 64) - 1)), max_size=300), st.sampled_from([64, 1024]))
def test_simple8b_round_trip(ids, block):
    words, blocks = simple8b.encode_ids(np.array(ids, np.uint64), block)
    assert simple8b.decode_ids(words, blocks, len(ids), block).tolist() == ids
    assert len(blocks) == -(-len(ids) // block)


def test_simple8b_files(spark, docs, empty):
    files = simple8b.write_ids(docs, shared_folder(spark, "ids"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in simple8b.read_ids(files, digest=True).collect())
    at, own, order = 0, {}, []
    for r in docs.collect():
        ids = np.array([*WORD.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        own.setdefault(r.doc_id, []).append((len(ids), crc32(ids.tobytes())))
    for start, doc_id, n, crc in got:  # documents lie without gaps in ascending doc_id order, nulls first
        assert start == at and (n, crc) in own[doc_id]
        own[doc_id].remove((n, crc))
        order.append((doc_id is not None, doc_id or 0))
        at += n
    assert not any(own.values()) and order == sorted(order)
    assert simple8b.read_ids(simple8b.write_ids(empty, shared_folder(spark, "none")), digest=True).count() == 0
    with pytest.raises(ValueError):
        simple8b.read_file(b"S8BIDS02" + b"\0" * 60)


def test_simple8b_files_are_cut_by_size(spark):
    rows = spark.range(3000).selectExpr("3000 - id AS doc_id", "concat('word ', id) AS text")
    files = simple8b.write_ids(rows, shared_folder(spark, "many"), file_bytes=2048)
    got = simple8b.read_ids(files).orderBy("start").collect()
    assert files.count() > 8 and [r.doc_id for r in got] == list(range(1, 3001))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert all(r.ids == [*WORD.encode(f"word {3000 - r.doc_id}", add_special_tokens=False).ids, 1] for r in got[::97])


def test_simple8b_hot_doc_id(spark):
    """A doc_id that most rows share is spread over the ranges."""
    rows = spark.range(2000).selectExpr("if(id % 4 > 0, 7, id) AS doc_id", "concat('word ', id) AS text")
    files = simple8b.write_ids(rows, shared_folder(spark, "hot"))
    got = simple8b.read_ids(files).orderBy("start").collect()
    assert files.count() == 4 and files.agg({"n": "max"}).first()[0] < 0.5 * sum(r.n_tokens for r in got)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == 2000
    want = sorted([*WORD.encode(f"word {i}", add_special_tokens=False).ids, 1] for i in range(2000))
    assert sorted(list(r.ids) for r in got) == want


def test_simple8b_least_doc_id(spark):
    rows = spark.createDataFrame([(-(1 << 63), "a"), (None, "b c"), (3, None)], "doc_id long, text string")
    got = simple8b.read_ids(simple8b.write_ids(rows, shared_folder(spark, "least"))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -(1 << 63), 3] and [r.n_tokens for r in got] == [3, 2, 1]


def test_wordpiece_counts(docs, empty):
    machine = wordpiece.automaton(bpe.file_path(wordpiece.VOCABULARY))
    with open(bpe.file_path(wordpiece.VOCABULARY)) as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = bpe.byte_letters()
    byte = {c: i for i, c in enumerate(letters)}
    to_bytes = lambda s: bytes(byte[c] for c in s)
    first = {to_bytes(s[1:]) for s in vocab if s[0] == letters[32] and len(s) > 1} | {bytes([b]) for b in range(256)}
    later = {to_bytes(s) for s in vocab if s[0] != letters[32]} | {bytes([b]) for b in range(256)}

    longest = max(map(len, first | later))

    def brute(word):
        n = at = 0
        while at < len(word):
            to = min(len(word), at + longest)
            while word[at:to] not in (later if at else first):
                to -= 1
            at, n = to, n + 1
        return n

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.binary(min_size=1, max_size=25), min_size=1, max_size=8))
    def check(words):
        assert machine.run(words).tolist() == [brute(w) for w in words]

    check()
    rng = np.random.default_rng(7)
    for words in ([bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (5000, 3, 900, 1, 40)], [b"ab" * 3000], [b"x"] * 3):
        assert machine.run(words).tolist() == [brute(w) for w in words]
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in wordpiece.token_counts(docs).collect())
    want = sorted((r.doc_id or 0, len((r.text or "").encode().split()), sum(map(brute, (r.text or "").encode().split()))) for r in docs.collect())
    assert got == want
    assert wordpiece.token_counts(empty).count() == 0


def test_packing(docs, empty):
    full = library(packing.VOCABULARY)
    wanted = {}
    for r in docs.collect():
        ids = [*full.encode(r.text or "", add_special_tokens=False).ids, 1]
        wanted.setdefault(r.doc_id, []).append(ids)
    rows = packing.pack(docs).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    for doc_id, texts in wanted.items():
        own = sorted((r.start, r.length, r.ids) for r in rows if r.doc_id == doc_id)
        assert sum(x[1] for x in own) == sum(map(len, texts))
        if len(texts) == 1:
            assert [i for x in own for i in x[2]] == texts[0]
    assert packing.pack(empty).count() == 0


def test_packing_prefers_neighbours():
    idf = np.ones(60)
    docs = [np.array([1, 2, 3, 4], np.uint16), np.array([50, 51, 52, 53], np.uint16), np.array([1, 2, 3, 9], np.uint16)]
    assert packing.fill(docs, idf, 4.0, 8)[0] == [(0, 0, 4), (2, 0, 4)]


def plain_bm25(docs, query, idf, mean):
    """BM25 by its formula, one document and term at a time."""
    out = []
    for d in docs:
        own = d.tolist()
        out.append(sum(idf[t] * own.count(t) * 2.2 / (own.count(t) + 1.2 * (0.25 + 0.75 * len(own) / mean)) for t in set(query.tolist()) if idf[t] > 0))
    return out


def plain_fill(docs, idf, mean, window):
    """fill by its definition: each piece the best unused document, of equal scores the first."""
    unused, out, seed, start = dict.fromkeys(range(len(docs))), [], None, 0
    while unused or seed is not None:
        if seed is None:
            seed, start = next(iter(unused)), 0
            del unused[seed]
        while len(docs[seed]) - start >= window:
            out.append([(seed, start, window)])
            start += window
        if start == len(docs[seed]):
            seed = None
            continue
        pieces, space = [(seed, start, len(docs[seed]) - start)], window - (len(docs[seed]) - start)
        scores = plain_bm25(docs, docs[seed], idf, mean)
        seed = None
        while space and unused:
            best = max(unused, key=lambda i: (round(scores[i], 9), -i))
            del unused[best]
            take = min(space, len(docs[best]))
            pieces.append((best, 0, take))
            space -= take
            if take < len(docs[best]):
                seed, start = best, take
        out += packing.halved(pieces) if space else [pieces]
    return out


def test_packing_equals_plain_bm25():
    rng = np.random.default_rng(11)
    for _ in range(12):
        docs = [rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint16) for _ in range(60)]
        docs += [docs[3], docs[3], np.array([1], np.uint16), np.array([1], np.uint16)]  # ties
        idf = np.maximum(rng.normal(1, 0.8, 40), 0)
        idf[1] = 0
        mean = float(np.mean([len(d) for d in docs]))
        assert packing.fill(docs, idf, mean, 32) == plain_fill(docs, idf, mean, 32)


def test_packing_many_empty_texts():
    """Documents of the end id alone share no term of weight: they fill in order, without a search each."""
    import time

    docs, began = [np.array([1], np.uint16)] * 200_000, time.perf_counter()
    out = packing.fill(docs, np.zeros(60), 1.0)
    assert sum(len(s) for s in out) == len(docs) and time.perf_counter() - began < 20
