"""Operator 1, BPE encoding and decoding: speculate and verify.

Texts are cut into words as the vocabulary file says; each distinct word is encoded once:

1. *Speculate*: greedy longest match over the vocabulary proposes tokens.
2. *Verify*: a sequence of tokens is what merging gives exactly when each token merges to itself and
   each adjacent pair is compatible, that is, no merge across their border comes due before both are
   whole.  All adjacent pairs of all proposed words are tested at once with numpy.
3. Only failing words are merged exactly, in lock step over all of them (very long ones with a heap).

Decoding joins the tokens' strings by one space, since the file names no decoder.

Words are cut, looked up by their bytes and learnt with numpy, many at once.

Defined results: null texts are empty; an empty text has no ids and decodes to the empty text; an empty table gives no rows;
repeated rows get equal results, rows of a null doc_id their own; extra columns are not read.  Texts of any length are encoded whole;
words above LONG_WORD bytes are proposed and tested like others, and merged with a heap where they fail.  A worker keeps at most
CACHE words, those met again when it is full.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, text_slices, with_clear_names

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps; letters beyond which a word is merged with a heap; verdicts kept; letters merged side by side;
#: characters cut side by side; the symbol of a word's end.
CACHE, LONG_WORD, PAIRS, MERGED, PIECE, CLOSE = 600_000, 256, 2_000_000, 1 << 20, 1 << 17, 256
NEVER = 1 << 30
STEP, MULTIPLIER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LOW_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)
HIGH_MASK = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(17)], np.uint64)
SPACES = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_loaded: dict[str, WordBPE] = {}
_classes: list[np.ndarray] = []


def file_path(name: str) -> str:
    """Place of a public vocabulary file; a path is taken as it is."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Hashed:
    """Open-addressing map of distinct non-negative 64-bit keys to numbers; all keys of a call are probed side by side."""

    def __init__(self, size: int = 1 << 12):
        self.shift, self.count = 64 - (size.bit_length() - 1), 0
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * STEP) >> np.uint64(self.shift)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; -1 for those it lacks."""
        at = self._home(keys)
        have = self.keys[at]
        out = self.values[at]
        other = have != keys
        go = np.flatnonzero(other & (have >= 0))
        out[other] = -1
        while len(go):
            at_go = (at[go] + 1) & (len(self.keys) - 1)
            at[go], have = at_go, self.keys[at_go]
            hit = have == keys[go]
            out[go[hit]] = self.values[at_go[hit]]
            go = go[~hit & (have >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that it lacks."""
        self.count += len(keys)
        if 2 * self.count > len(self.keys):
            mine = self.keys >= 0
            old = self.keys[mine], self.values[mine]
            self.__init__(1 << (4 * self.count - 1).bit_length())
            self.put(np.concatenate((old[0], keys)), np.concatenate((old[1], values)))
            return
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several keys at a place the last stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & (len(self.keys) - 1)


class WordTable:
    """Slots of words by their bytes.  Words of up to 16 bytes are found side by side by their exact bytes, longer ones by a dict.

    A row of ``rows`` is a short word's 16 bytes, its size and its slot + 1.  When the table is full, only words met again since the last
    time stay (two generations), so frequent words are kept.
    """

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.n, self.long = 0, {}
        self.again, self.rows = np.zeros(1 << 12, bool), np.zeros((1 << 14, 4), np.uint64)

    @staticmethod
    def read(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first 16 bytes of each word as two numbers, zeros behind its end; data is padded by 32 bytes to a multiple of 8."""
        words = data.view(np.uint64)
        at, shift = first >> 3, ((first & 7) << 3).astype(np.uint64)
        back = np.uint64(63) - shift
        a, b = words[at], words[at + 1]
        low = ((a >> shift) | ((b << back) << np.uint64(1))) & LOW_MASK[np.minimum(size, 16)]
        high = np.zeros(len(first), np.uint64)
        more = np.flatnonzero(size > 8)
        s, k = shift[more], back[more]
        high[more] = ((b[more] >> s) | ((words[at[more] + 2] << k) << np.uint64(1))) & HIGH_MASK[np.minimum(size[more], 16)]
        return low, high

    def _home(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (low ^ (high * STEP) ^ size.view(np.uint64)) * MULTIPLIER
            x ^= x >> np.uint64(32)
            x *= STEP
            return (x >> np.uint64(65 - len(self.rows).bit_length())).view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Slots of short words; -1 for new ones."""
        at = self._home(low, high, size)
        wide = size.view(np.uint64)
        out = np.empty(len(at), np.int64)
        go = None
        while True:
            row = np.take(self.rows, at, 0)
            slot = row[:, 3].astype(np.int64) - 1
            if go is None:
                out[:] = slot
                same = (row[:, 0] == low) & (row[:, 1] == high) & (row[:, 2] == wide)
                go = np.flatnonzero(~same & (slot >= 0))
                at = at[go]
            else:
                out[go] = slot
                same = (row[:, 0] == low[go]) & (row[:, 1] == high[go]) & (row[:, 2] == wide[go])
                on = ~same & (slot >= 0)
                go, at = go[on], at[on]
            if not len(go):
                return out
            at = (at + 1) & (len(self.rows) - 1)

    def _room(self, more: int) -> None:
        need = self.n + more
        if need > len(self.again):
            self.again = np.concatenate((self.again, np.zeros(max(need, 2 * len(self.again)) - len(self.again), bool)))
        if 3 * need > 2 * len(self.rows):
            old = self.rows[self.rows[:, 3] > 0]
            self.rows = np.zeros((1 << (2 * need - 1).bit_length(), 4), np.uint64)
            self._place(old)

    def _place(self, new: np.ndarray) -> None:
        at = self._home(new[:, 0], new[:, 1], new[:, 2].view(np.int64))
        while len(new):
            free = np.flatnonzero(self.rows[at, 3] == 0)
            self.rows[at[free]] = new[free]
            lost = self.rows[at, 3] != new[:, 3]
            new, at = new[lost], (at[lost] + 1) & (len(self.rows) - 1)

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, long: list[bytes]) -> None:
        """New short words, then new long ones, get the next slots."""
        short = len(low)
        self._room(short + len(long))
        slots = np.arange(self.n + 1, self.n + 1 + short)
        self._place(np.stack((low, high, size.view(np.uint64), slots.view(np.uint64)), 1))
        self.long.update(zip(long, range(self.n + short, self.n + short + len(long)), strict=True))
        self.again[self.n : self.n + short + len(long)] = False
        self.n += short + len(long)

    def keep(self) -> np.ndarray:
        """Drops words that were not met again; the kept slots in their new order."""
        kept = np.flatnonzero(self.again[: self.n])
        if 2 * len(kept) > self.most:
            kept = kept[:0]
        place = np.zeros(self.n + 1, np.uint64)
        place[kept + 1] = np.arange(1, len(kept) + 1)
        rows = self.rows[self.rows[:, 3] > 0]
        rows[:, 3] = place[rows[:, 3].view(np.int64)]
        long = {w: int(place[i + 1]) - 1 for w, i in self.long.items() if place[i + 1]}
        self.forget()
        self._room(len(kept))
        self._place(rows[rows[:, 3] > 0])
        self.n, self.long = len(kept), long
        return kept


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, then those from first[1], and so on."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordBPE:
    """Encoder of a byte-level vocabulary whose words end in ``</w>``."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        suffix = spec["model"]["end_of_word_suffix"]
        self.letters = byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        size = max([*vocab.values(), *special.values()]) + 1
        self.vocabulary_size = size
        self.strings = [""] * size
        for s, i in [*vocab.items(), *special.items()]:
            self.strings[i] = s
        self.bytes = [s.encode() for s in self.strings]
        self.decimals = [str(i).encode() for i in range(size)]
        self.base = np.array([vocab[c] for c in self.letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in self.letters], np.int64)
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        proper = {vocab[c]: (b,) for b, c in enumerate(self.letters)} | {vocab[c + suffix]: (b, CLOSE) for b, c in enumerate(self.letters)}
        keys, made = [], []
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys.append((x << 20) | y), made.append(z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
                proper[z] = proper[x] + proper[y]
        self.made, self.merges, self.verdicts = np.array(made, np.int64), Hashed(), Hashed()
        self.merges.put(np.array(keys, np.int64), np.arange(len(keys), dtype=np.int32))
        sound = set()
        for closed in (True, False):
            own = [(i, s[:-1] if closed else s) for i, s in proper.items() if (s[-1] == CLOSE) == closed]
            sizes = np.array([len(s) for _, s in own], np.int64)
            flat, lengths = self.merge_all(np.fromiter(chain.from_iterable(s for _, s in own), np.int64), sizes, closed)
            starts = np.cumsum(lengths) - lengths
            sound |= {i for (i, _), n, a in zip(own, lengths.tolist(), starts.tolist(), strict=True) if n == 1 and flat[a] == i}
        #: Only tokens that merge to themselves are proposed.  A trie holds them: an edge's key is node * 512 + symbol.
        edges, accepts = {}, [-1]
        for i in sorted(sound):
            node = 0
            for c in proper[i]:
                key = node * 512 + c
                if key not in edges:
                    edges[key] = len(accepts)
                    accepts.append(-1)
                node = edges[key]
            accepts[node] = i
        self.edges, self.accepts = Hashed(), np.array(accepts, np.int64)
        self.edges.put(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32))
        self.roots = np.array([edges.get(c, -1) for c in range(512)], np.int32)
        self.table = WordTable(CACHE)
        self.forget()

    def forget(self) -> None:
        self.table.forget()
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def propose(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: (flat tokens, tokens per word, words not covered).

        symbols: the words' bytes, each word with CLOSE behind it, which is in ``sizes``.  The longest piece from every place is found
        side by side, then each word's path of longest pieces is walked.  A word is uncovered where no piece begins, as where its
        longest match leaves CLOSE alone; it is merged exactly instead.
        """
        n = len(symbols)
        ends = np.cumsum(sizes)
        limit = np.repeat(ends, sizes)
        node = self.roots[symbols].astype(np.int64)
        best, reach = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        go, depth = np.flatnonzero(node >= 0), 1
        node = node[go]
        while len(go):
            token = self.accepts[node]
            fits = np.flatnonzero(token >= 0)
            best[go[fits]], reach[go[fits]] = token[fits], depth
            inside = np.flatnonzero(go + depth < limit[go])
            go, node = go[inside], node[inside]
            node = self.edges.get(node * 512 + symbols[go + depth]).astype(np.int64)
            on = np.flatnonzero(node >= 0)
            go, node, depth = go[on], node[on], depth + 1
        at, owner = ends - sizes, np.arange(len(sizes))
        wrong = np.zeros(len(sizes), bool)
        chosen = np.zeros(n, bool)
        for _ in range(LONG_WORD):
            if not len(at):
                break
            stuck = best[at] < 0
            wrong[owner[stuck]] = True
            at, owner = at[~stuck], owner[~stuck]
            chosen[at] = True
            at = at + reach[at]
            on = at < ends[owner]
            at, owner = at[on], owner[on]
        for p, o in zip(at.tolist(), owner.tolist(), strict=True):  # the few that have more pieces, one by one
            end = int(ends[o])
            while p < end and best[p] >= 0:
                chosen[p] = True
                p += int(reach[p])
            wrong[o] |= p < end
        begin = np.concatenate(([0], np.cumsum(chosen)))
        return best[chosen], np.diff(begin[np.concatenate(([0], ends))]), wrong

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether merging keeps their border.

        Going back in time from the finished tokens: x and y are what touches the border from either
        side, and live until ``limit``.  A merge of (x, y) of lower rank would have come first.  Of equal
        pairs the left one merges first, which is why a right token gives way one rank later.
        """
        good, where = np.ones(len(a), bool), np.arange(len(a))
        x, y, limit = a.astype(np.int64), b.astype(np.int64), np.full(len(a), NEVER, np.int64)
        while len(where):
            rank = self.merges.get((x << 20) | y)
            crossing = (rank >= 0) & (rank < limit)
            good[where[crossing]] = False
            go = ~crossing & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            where, x, y = where[go], x[go], y[go]
            undo_left = self.rank[x] > self.rank[y]
            limit = np.where(undo_left, self.rank[x], self.rank[y] + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return good

    def fits(self, pairs: np.ndarray) -> np.ndarray:
        """The verdict of each pair of tokens (a << 20 | b); verdicts are kept."""
        known = self.verdicts.get(pairs)
        new = np.unique(pairs[known < 0])
        if len(new):
            if self.verdicts.count + len(new) > PAIRS:
                self.verdicts = Hashed()
                new = np.unique(pairs)
            self.verdicts.put(new, self.compatible(new >> 20, new & 0xFFFFF).astype(np.int32))
            known = self.verdicts.get(pairs)
        return known > 0

    def merge_all(self, letters: np.ndarray, sizes: np.ndarray, closed: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all words in lock step, very long ones with a heap: (flat tokens, tokens per word)."""
        tokens = self.base[letters]
        if closed:
            ends = np.cumsum(sizes)[sizes > 0] - 1
            tokens[ends] = self.last[letters[ends]]
        counts, out = np.zeros(len(sizes), np.int64), np.full(len(letters), -1, np.int64)
        begin = np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes > LONG_WORD)
        for i in long.tolist():
            found = self.merge_long(tokens[begin[i] : begin[i] + sizes[i]].tolist())
            out[begin[i] : begin[i] + len(found)], counts[i] = found, len(found)
        short = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
        edges = np.cumsum(sizes[short])
        for part in np.split(short, np.searchsorted(edges, np.arange(1, int(edges[-1] if len(edges) else 0) // MERGED + 1) * MERGED)):
            self._merge_short(tokens, part, begin, sizes, out, counts)
        return out[out >= 0], counts

    def _merge_short(self, all_tokens: np.ndarray, words: np.ndarray, begin: np.ndarray, sizes: np.ndarray, out: np.ndarray, counts: np.ndarray) -> None:
        """One merge of each unfinished word a round: of its pairs that of the least rank, the first of equal ones."""
        if not len(words):
            return
        tokens, size = all_tokens[ragged(begin[words], sizes[words])], sizes[words]

        def ranks(at: np.ndarray) -> np.ndarray:
            found = self.merges.get((tokens[at] << 20) | tokens[at + 1]).astype(np.int64)
            return np.where(found < 0, NEVER, found)

        rank = np.full(len(tokens), NEVER, np.int64)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(size) - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner] = ranks(inner)
        while len(words):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat((rank << 24) | np.arange(len(rank)), first)
            done = (least >> 24) >= NEVER
            if done.any():
                out[ragged(begin[words[done]], size[done])] = tokens[np.repeat(done, size)]
                counts[words[done]] = size[done]
                live = np.repeat(~done, size)
                shift = (first - (np.cumsum(np.where(done, 0, size)) - size))[~done]
                tokens, rank, least = tokens[live], rank[live], least[~done]
                words, size = words[~done], size[~done]
                if not len(words):
                    return
                at = (least & 0xFFFFFF) - shift
                first = np.cumsum(size) - size
            else:
                at = least & 0xFFFFFF
            tokens[at] = self.made[least >> 24]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            rank[at] = rank[at + 1]  # whether a pair follows; it is ranked anew below
            tokens, rank = tokens[keep], rank[keep]
            at, size = at - np.arange(len(at)), size - 1
            first = first - np.arange(len(first))
            right = at[at < first + size - 1]
            rank[at[at == first + size - 1]] = NEVER
            rank[right] = ranks(right)
            left = at[at > first] - 1
            rank[left] = ranks(left)

    def merge_long(self, tokens: list[int]) -> list[int]:
        """Exact merging of one long word's letters with a heap: n log n."""
        if not hasattr(self, "pairs"):
            mine = self.merges.keys >= 0
            self.pairs = dict(zip(self.merges.keys[mine].tolist(), self.merges.values[mine].tolist(), strict=True))
        n = len(tokens)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.pairs.get((tokens[i] << 20) | tokens[j])) is not None:
                heapq.heappush(heap, (found, i, tokens[i], tokens[j]))

        for i in range(n):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in tokens if t >= 0]

    def encode_words(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat tokens, tokens per word) of distinct words, given by their bytes."""
        symbols = np.full(len(letters) + len(sizes), CLOSE, np.int64)
        symbols[np.arange(len(letters)) + np.repeat(np.arange(len(sizes)), sizes)] = letters
        flat, lengths, wrong = self.propose(symbols, sizes + 1)
        owner = np.repeat(np.arange(len(sizes)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = ~self.fits((flat[inner] << 20) | flat[inner + 1])
        wrong[owner[inner[bad]]] = True
        if not wrong.any():
            return flat, lengths
        again = np.flatnonzero(wrong)
        exact, counts = self.merge_all(letters[np.repeat(wrong, sizes)], sizes[again])
        right = flat[~np.repeat(wrong, lengths)]
        lengths[again] = counts
        out, mine = np.empty(int(lengths.sum()), np.int64), np.repeat(wrong, lengths)
        out[mine], out[~mine] = exact, right
        return out, lengths

    def words(self, text: str) -> list[str]:
        """Words of one text, as the library cuts them."""
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_file(self.path)
        byte = {c: i for i, c in enumerate(self.letters)}
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(byte.__getitem__, w)).decode() for w, _ in cut]

    def _odd_slots(self, text: str) -> np.ndarray:
        """Slots of a text that has special tokens or characters newer than Python's tables."""
        parts = self.split_special.split(text) if self.split_special else [text]
        found = []
        for k, part in enumerate(parts):
            if k % 2:
                mark = b"\0" + part.encode()
                if mark not in self.table.long:
                    self._keep(np.array([self.special[part]], np.int64), np.ones(1, np.int64))
                    self.table.add(*[np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64), [mark])
                found.append(np.array([self.table.long[mark]], np.int64))
            elif part:
                data, first, size, unknown, _ = cut([normal(part)])
                if unknown:
                    words = [w.encode() for w in self.words(part)]
                    size = np.array([len(w) for w in words], np.int64)
                    data, first = padded(b"".join(words)), np.cumsum(size) - size
                found.append(self._slots([(data, first, size)]))
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def _slots(self, pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """Slots of words, each piece given by bytes and the words' places and sizes in them; new ones are learnt."""
        table, found, news, longs, at = self.table, [], [], [], 0
        for data, first, size in pieces:
            low, high = table.read(data, first, size)
            slots = table.find(low, high, size)
            is_long = np.flatnonzero(size > 16)
            if len(is_long):
                whole = [data[a : a + n].tobytes() for a, n in zip(first[is_long].tolist(), size[is_long].tolist(), strict=True)]
                slots[is_long] = [table.long.get(w, -1) for w in whole]
                longs += [(at + i, w) for i, w in zip(is_long.tolist(), whole, strict=True) if w not in table.long]
            known = slots >= 0
            table.again[slots[known]] = True
            new = np.flatnonzero(~known & (size <= 16))
            news.append((at + new, low[new], high[new], size[new], data[ragged(first[new], size[new])]))
            found.append(slots)
            at += len(slots)
        slots = np.concatenate(found) if found else np.zeros(0, np.int64)
        if at and (longs or any(len(x[0]) for x in news)):
            where, low, high, size, letters = (np.concatenate(x) for x in zip(*news, strict=True))
            order = np.lexsort((high, low))
            a, b = order[:-1], order[1:]
            fresh = np.concatenate((np.ones(min(1, len(order)), bool), (low[a] != low[b]) | (high[a] != high[b]) | (size[a] != size[b])))
            chosen = order[fresh]
            long = list(dict.fromkeys(w for _, w in longs))
            begin = table.n
            sizes = np.concatenate((size[chosen], np.array([len(w) for w in long], np.int64)))
            own = letters[ragged((np.cumsum(size) - size)[chosen], size[chosen])]
            self._keep(*self.encode_words(np.concatenate((own, np.frombuffer(b"".join(long), np.uint8))).astype(np.int64), sizes))
            table.add(low[chosen], high[chosen], size[chosen], long)
            slots[where[order]] = begin + np.cumsum(fresh) - 1
            for i, w in longs:
                slots[i] = table.long[w]
        return slots

    def _keep(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Stores the tokens of the next slots."""
        first, size = self.table.n, self.table.n + len(lengths)
        while size > len(self.starts):
            self.starts, self.lengths = np.concatenate((self.starts, self.starts)), np.concatenate((self.lengths, self.lengths))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, self.flat))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[first:size] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:size] = lengths
        self.used += len(flat)

    def _trim(self) -> None:
        """Keeps frequent words only where the table is full."""
        if self.table.n <= CACHE and self.used <= 16 * CACHE:
            return
        kept = self.table.keep()
        lengths = self.lengths[kept]
        flat = self.flat[ragged(self.starts[kept], lengths)]
        if len(flat) > 8 * CACHE:
            self.forget()
            return
        n, self.table.n, self.used = self.table.n, 0, 0
        self._keep(flat, lengths)
        self.table.n = n

    def encode_batch(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text), with end_id behind each text if given."""
        self._trim()
        lows, odd = [], []
        for i, t in enumerate(texts):
            if "<|" in t and self.split_special:
                odd.append(i)
                lows.append("")
            else:
                lows.append(normal(t))
        pieces, counts, unknown = cut_all(lows)
        if unknown:  # characters newer than Python's tables: those texts are cut by the library's
            strange = [i for i, t in enumerate(lows) if unassigned(t)]
            odd = sorted({*odd, *strange})
            for i in strange:
                lows[i] = ""
            pieces, counts, _ = cut_all(lows)
        slots = self._slots(pieces)
        if odd:
            parts, at, edge = [], 0, np.concatenate(([0], np.cumsum(counts)))
            for i in odd:
                mine = self._odd_slots(texts[i])
                parts += [slots[at : edge[i]], mine]
                at, counts[i] = edge[i], len(mine)
            slots = np.concatenate([*parts, slots[at:]])
        lengths = self.lengths[slots]
        ids = self.flat[ragged(self.starts[slots], lengths)]
        total = np.concatenate(([0], np.cumsum(lengths)))
        per_text = np.diff(total[np.concatenate(([0], np.cumsum(counts)))])
        if end_id is None:
            return ids, per_text
        out = np.full(len(ids) + len(texts), end_id, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), per_text)] = ids
        return out, per_text + 1

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8."""
        return b" ".join(map(self.bytes.__getitem__, ids))


def normal(text: str) -> str:
    """As the file's normalizer: NFC, lower case."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def unassigned(text: str) -> bool:
    return not text.isascii() and bool((classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == 4).any())


def padded(data: bytes) -> np.ndarray:
    """The bytes and 32 zeros or more, a multiple of 8 in all."""
    return np.frombuffer(data + bytes(40 - len(data) % 8), np.uint8)


def classes() -> np.ndarray:
    """The class of each character: 0 letter, 1 number, 2 space, 3 other, 4 not assigned."""
    if not _classes:
        kind = {"L": 0, "N": 1}
        found = np.array([4 if (c := unicodedata.category(chr(i))) == "Cn" else kind.get(c[0], 3) for i in range(0x110000)], np.uint8)
        found[[i for a, b in SPACES for i in range(a, b + 1)]] = 2
        _classes.append(found)
    return _classes[0]


def cut(lows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool, np.ndarray]:
    """Words of normalized texts, as the file's pre_tokenizer cuts them: runs of letters, single numbers, runs of other characters, and
    'm, 't and the like: (UTF-8 bytes, first byte and size of each word, whether a character is not assigned, words per text)."""
    joined = " ".join(lows)
    if joined.isascii():
        points = np.frombuffer(joined.encode(), np.uint8)
    else:
        try:
            points = np.frombuffer(joined.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    change = np.ones(len(kind), bool)
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
    first = np.flatnonzero(change)
    size = np.diff(np.append(first, len(kind)))
    cls = kind[first]
    mark = np.flatnonzero((points[first[:-1]] == 39) & (size[:-1] == 1) & (cls[1:] == 0)) if len(first) > 1 else first[:0]
    if len(mark):
        more = np.append(points, np.zeros(2, points.dtype))
        x, y = more[first[mark] + 1], more[first[mark] + 2]
        one = (x == 115) | (x == 116) | (x == 109) | (x == 100)  # 's 't 'm 'd
        two = ((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))  # 're 've 'll
        step = np.where(one, 1, np.where(two, 2, 0))
        size[mark] += step
        first[mark + 1] += step
        size[mark + 1] -= step
    words = (cls != 2) & (size > 0)
    first, size = first[words], size[words]
    edges = np.cumsum(np.array([len(t) + 1 for t in lows], np.int64))
    per_text = np.diff(np.searchsorted(first, np.concatenate(([0], edges))))
    if not joined.isascii():
        wide = (points > 127).astype(np.uint8)
        if points.dtype == np.uint32:
            wide += (points > 0x7FF).view(np.uint8) + (points > 0xFFFF).view(np.uint8)
        place = np.concatenate(([0], np.cumsum(wide, dtype=np.int64)))
        last = first + size
        first, last = first + place[first], last + place[last]
        size = last - first
    return padded(joined.encode()), first, size, bool((cls == 4).any()), per_text


def cut_all(lows: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, bool]:
    """cut in pieces that processors' caches hold: (bytes, first, size) of each, words per text, whether a character is not assigned."""
    pieces, counts, unknown, at, size = [], [], False, 0, 0
    for i, t in enumerate(lows):
        size += len(t)
        if size >= PIECE or i == len(lows) - 1:
            *piece, strange, own = cut(lows[at : i + 1])
            pieces.append(tuple(piece)), counts.append(own)
            unknown, at, size = unknown or strange, i + 1, 0
    return pieces, np.concatenate(counts) if counts else np.zeros(0, np.int64), unknown


def encoder(path: str) -> WordBPE:
    """One encoder per worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encoded_slices(batch: pa.RecordBatch, column: int, path: str, end_id: int | None = None):
    """(rows, ids, ids per row) for slices of a batch, with end_id behind each row's if given."""
    bpe = encoder(path)
    for rows, _, _ in text_slices(batch, column):
        yield rows, *bpe.encode_batch([t or "" for t in rows.column(column).to_pylist()], end_id)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row.  No shuffle."""
    path = file_path(vocabulary)

    def run(batch: pa.RecordBatch):
        for rows, ids, counts in encoded_slices(batch, 1, path):
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield [rows.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))]

    return arrow_map(_rows(docs, key, text), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of each row of ``encode``."""
    path = file_path(vocabulary)

    def run(batch: pa.RecordBatch):
        bpe = encoder(path)
        yield [batch.column(0), [bpe.decode(x or []).decode() for x in batch.column(1).to_pylist()]]

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass; digests of both instead of ids and texts."""
    path = file_path(vocabulary)

    def run(batch: pa.RecordBatch):
        bpe = encoder(path)
        for rows, ids, counts in encoded_slices(batch, 1, path):
            at, a, b = 0, [], []
            for n in counts.tolist():
                own = ids[at : at + n].tolist()
                a.append(sha256(b" ".join(map(bpe.decimals.__getitem__, own))).hexdigest())
                b.append(sha256(bpe.decode(own)).hexdigest())
                at += n
            yield [rows.column(0), counts, a, b]

    return arrow_map(_rows(docs, key, text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return with_clear_names(docs, key, text).select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string"))


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
