"""Operator 2, token counts: greedy word pieces counted by a linear longest-match automaton.

A word's pieces are the longest vocabulary entries from left to right.  Trying lengths again from each
piece's end is quadratic; the automaton reads each byte once.  Its states are the nodes of the
vocabulary's trie.  Each state has a failure link: the state reached when the longest pieces at the
front of what it stands for are popped, and the count of pieces popped on that way.  Reading a byte with
no edge follows failure links and adds their counts, so lengths come without building any piece.

Pieces that start a word carry the vocabulary's mark of a preceding space; all others continue one.
Every single byte is a piece, so no word lacks pieces.  All distinct words of a slice of text are run side
by side, one byte of each at a time; the few that are longer than all others are finished one by one.

Defined results: null and empty texts have 0 words and 0 tokens; repeated rows get equal counts, rows of a null doc_id their own; an
empty table gives no rows; texts and words of any length are counted whole; extra columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Hashed, _rows, byte_letters, file_path
from .common import arrow_map, table, text_slices

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker keeps, bytes that these have in all, and words that are few enough to go one by one.
CACHE, CACHE_BYTES, FEW = 400_000, 16 << 20, 8
_loaded: dict[str, Automaton] = {}


class Automaton:
    """States 0 and 1 are the roots of a word's start and of later pieces; an edge's key is state * 256 + byte."""

    def __init__(self, first: list[bytes], later: list[bytes]):
        """first: pieces at a word's start (without mark); later: pieces inside a word.  Any byte must be a piece of each kind."""
        children: list[dict[int, int]] = [{}, {}]
        ends = [False, False]
        depth = [0, 0]
        kind = [0, 1]
        for root, words in ((0, first), (1, later)):
            for word in words:
                at = root
                for byte in word:
                    to = children[at].get(byte)
                    if to is None:
                        to = len(children)
                        children.append({}), ends.append(False), depth.append(depth[at] + 1), kind.append(root)
                        children[at][byte] = to
                    at = to
                ends[at] = True
        n = len(children)
        self.link, self.pop = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.n = n
        self.edges = {at * 256 + byte: to for at, edges in enumerate(children) for byte, to in edges.items()}
        self.edge = Hashed()
        self.edge.put(np.array(list(self.edges), np.int64), np.array(list(self.edges.values()), np.int32))
        # by depth: a piece's own end pops itself; else follow the parent's links until the byte has an edge
        parent = {to: (at, byte) for at, edges in enumerate(children) for byte, to in edges.items()}
        for state in sorted(parent, key=depth.__getitem__):
            at, byte = parent[state]
            if ends[state]:
                self.link[state], self.pop[state] = 1, 1
                continue
            link, pops = int(self.link[at]), int(self.pop[at])
            while link >= 0 and byte not in children[link]:
                link, pops = int(self.link[link]), pops + int(self.pop[link])
            self.link[state], self.pop[state] = (children[link][byte], pops) if link >= 0 else (-1, 0)
        self.counts: dict[bytes, int] = {}
        self.size = 0

    def run(self, words: list[bytes]) -> np.ndarray:
        """Number of pieces of each word, all words one byte at a time."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        state, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live, at = len(words), 0
        while live:
            live = int(np.searchsorted(-lengths, -at, "left"))  # those longer than `at`
            if live <= FEW and at:
                for i in range(live):
                    state[i], count[i] = self._finish(int(state[i]), int(count[i]), data[starts[i] + at : starts[i] + lengths[i]].tobytes())
                break
            byte = data[starts[:live] + at].astype(np.int64)
            self._step(state, count, live, byte)
            at += 1
        todo = np.flatnonzero(state != 1)  # pop what is left until the root of later pieces
        while len(todo):
            count[todo] += self.pop[state[todo]]
            state[todo] = self.link[state[todo]]
            todo = todo[state[todo] > 1]
        out = np.empty(len(words), np.int64)
        out[order] = count
        return out

    def _finish(self, state: int, count: int, rest: bytes) -> tuple[int, int]:
        """State and count after the rest of one word."""
        edges, link, pop = self.edges, self.link, self.pop
        for byte in rest:
            while (to := edges.get(state * 256 + byte)) is None:
                count += int(pop[state])
                state = int(link[state])
            state = to
        return state, count

    def _step(self, state: np.ndarray, count: np.ndarray, live: int, byte: np.ndarray) -> None:
        to = self.edge.get(state[:live] * 256 + byte)
        stuck = np.flatnonzero(to < 0)
        while len(stuck):
            s = state[stuck]
            count[stuck] += self.pop[s]
            state[stuck] = self.link[s]
            to[stuck] = self.edge.get(state[stuck] * 256 + byte[stuck])
            stuck = stuck[to[stuck] < 0]
        state[:live] = to

    def count_words(self, found: list[list[bytes]]) -> np.ndarray:
        """Pieces of all words of each text."""
        if len(self.counts) > CACHE or self.size > CACHE_BYTES:
            self.counts, self.size = {}, 0
        new = set()
        for words in found:
            new.update(words)
        new -= self.counts.keys()
        if new:
            new = list(new)
            self.size += sum(map(len, new))
            self.counts.update(zip(new, self.run(new).tolist(), strict=True))
        return np.array([sum(map(self.counts.__getitem__, words)) for words in found], np.int64)


def automaton(path: str) -> Automaton:
    """Automaton of a byte-level vocabulary file, one per worker."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = {c: i for i, c in enumerate(byte_letters())}
        mark = byte_letters()[32]
        single = [bytes([b]) for b in range(256)]
        first = [bytes(map(byte.__getitem__, s[1:])) for s in vocab if s[0] == mark and len(s) > 1]
        later = [bytes(map(byte.__getitem__, s)) for s in vocab if s[0] != mark]
        _loaded[path] = Automaton([*{*first, *single}], [*{*later, *single}])
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row.  No shuffle."""
    path = file_path(vocabulary)

    def run(batch: pa.RecordBatch):
        machine = automaton(path)
        for rows, data, offsets in text_slices(batch, 1):
            whole = data.tobytes()
            found = [whole[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield [rows.column(0), [len(w) for w in found], machine.count_words(found)]

    return arrow_map(_rows(docs, key, text), run, "doc_id long, n_words long, n_tokens long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
