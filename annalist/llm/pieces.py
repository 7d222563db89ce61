"""Operator 13, SentencePiece encoding and decoding: vectorised merge rounds.

A text gets a leading space, spaces become the mark ``▁``, and its characters are symbols.  Symbols merge pair by pair, the pair of the
best score first and of equal scores the leftmost, until no pair is a piece.  Texts are cut where no piece can reach across, and all
distinct words so found are merged together, as one flat array of symbols:

1. each word's least pair rank comes from a segmented minimum;
2. all its pairs of that rank merge at once, from the left and without overlap;
3. the array is compacted and the pairs beside merged symbols are ranked again; words without a pair leave.

Pairs of one rank merge together only where nothing can come between them: a piece that begins or ends one of a rank not above its own
merges one place a round.  Words above LONG symbols go through a heap.  Characters that are no piece become their bytes' pieces.
Decoding joins the pieces' bytes, takes the leading mark away and turns the others into spaces.

Defined results: null texts are empty; an empty text has no ids and decodes to the empty text; an empty table gives no rows; repeated
rows get equal results, rows of a null doc_id their own; extra columns, whatever their names, are not read.  Texts of any length are
encoded whole.  A worker keeps at most ``bpe.CACHE`` words, those met again when it is full.  A text that holds ``▁`` decodes with
spaces there, as the library's does.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE, NEVER, Hashed, WordBPE, WordTable, file_path, ragged
from .common import arrow_map, table, text_slices, with_clear_names

MODEL = "piece_bpe_32k.model"
MARK = "▁"
SPELLED_MARK = MARK.encode()
#: Symbols beyond which a word is merged with a heap; words that are looked up side by side; bits of a symbol.
LONG, SIDE, BITS = 4096, 1 << 15, 21
_loaded: dict[str, PieceBPE] = {}


class PieceBPE(WordBPE):
    """Encoder of a SentencePiece BPE model without normalization; the store of words is WordBPE's."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        self.path, size = path, library.get_piece_size()
        names = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        ids = {names[i]: i for i in plain}
        scores = np.array([library.get_score(i) for i in range(size)])
        order = {s: r for r, s in enumerate(np.unique(-scores[plain]).tolist())}
        rank = {s: order[-scores[i]] for s, i in ids.items()}
        self.size, self.unknown = size, library.unk_id()
        self.byte_ids = np.full(256, -1, np.int64)
        for i in range(size):
            if library.is_byte(i):
                self.byte_ids[int(names[i][3:-1], 16)] = i
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int64)  # characters that are no piece
        for s, i in ids.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.symbol[ord(" ")] = self.symbol[ord(MARK)]
        longer = [s for s in ids if len(s) > 1]
        pairs, bigrams, self.one_by_one = {}, set(), np.zeros(size, bool)
        number = lambda s: int(self.symbol[ord(s)]) if len(s) == 1 else ids.get(s, -1)
        for s in longer:
            for k in range(1, len(s)):
                a, b = number(s[:k]), number(s[k:])
                bigrams.add((int(self.symbol[ord(s[k - 1])]) << BITS) | int(self.symbol[ord(s[k])]))
                if a >= 0 and b >= 0:
                    pairs[(a << BITS) | b] = ids[s]
                for part in (s[:k], s[k:]):
                    if len(part) > 1 and rank.get(part, -1) >= rank[s]:
                        self.one_by_one[ids[part]] = True
        keys = np.array(list(pairs), np.int64)
        #: Piece and rank of each pair; the last entry stands for pairs that are no piece.
        self.made = np.array([*pairs.values(), -1], np.int64)
        self.rank = np.array([*(rank[names[i]] for i in pairs.values()), NEVER], np.int64)
        self.merges, self.bigrams = Hashed(), Hashed()
        self.merges.put(keys, np.arange(len(keys), dtype=np.int32))
        self.bigrams.put(np.array(sorted(bigrams), np.int64), np.ones(len(bigrams), np.int32))
        self.pairs = {k: (rank[names[i]], i) for k, i in pairs.items()}
        #: Words begin before a space that follows another character, and on either side of single-byte characters that no longer piece has.
        self.at_spaces = not any(b == MARK != a for s in longer for a, b in zip(s, s[1:], strict=False))
        inside = set("".join(longer))
        self.alone = np.array([c < 128 and c != 32 and chr(c) not in inside for c in range(256)])
        texts = [names[i].replace(MARK, " ").encode() for i in range(size)]
        for i in range(size):
            if library.is_byte(i):
                texts[i] = bytes([int(names[i][3:-1], 16)])
            elif library.is_control(i):
                texts[i] = b""
            elif library.is_unknown(i):
                texts[i] = " ⁇ ".encode()
        self.leading = np.array([names[i].startswith(MARK) for i in range(size)])
        self.spelled, self.decimals = Strings(texts), Strings([b"%d," % i for i in range(size)])
        self.table = WordTable(CACHE)
        self.forget()

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(padded bytes with each text's leading space, first byte and size of each word, words per text)."""
        sizes = np.diff(offsets)
        has = sizes > 0
        ends = np.cumsum(sizes + has)
        n = int(ends[-1]) if len(ends) else 0
        out = np.zeros(n + 40 - n % 8, np.uint8)
        text = out[:n]
        text[:] = 32
        text[np.arange(len(data)) + np.repeat(np.cumsum(has), sizes)] = data
        start = np.zeros(n, bool)
        start[(ends - sizes - has)[has]] = True
        if self.at_spaces:
            space = text == 32
            before = space[:-1]
            if SPELLED_MARK in data.tobytes():  # a mark in the text itself is a space
                before = before.copy()
                before[2:] |= (text[:-3] == SPELLED_MARK[0]) & (text[1:-2] == SPELLED_MARK[1]) & (text[2:-1] == SPELLED_MARK[2])
            start[1:] |= space[1:] & ~before
        alone = self.alone[text]
        start |= alone
        start[1:] |= alone[:-1]
        first = np.flatnonzero(start)
        return out, first, np.diff(np.append(first, n)), np.diff(np.searchsorted(first, np.concatenate(([0], ends))))

    def encode_words(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat tokens, tokens per word) of distinct words, given by their bytes in UTF-8."""
        raw = letters.astype(np.uint8)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        word_ends = heads[np.cumsum(sizes)]
        symbols = self.symbol[points]
        # a segment ends with its word, or where no piece holds the two characters side by side
        last = np.zeros(len(symbols), bool)
        last[word_ends[sizes > 0] - 1] = True
        inner = np.flatnonzero(~last)
        last[inner[self.bigrams.get((symbols[inner] << BITS) | symbols[inner + 1]) < 0]] = True
        ends = np.flatnonzero(last) + 1
        flat, counts = self.merge(symbols, np.diff(np.concatenate(([0], ends))))
        total = np.concatenate(([0], np.cumsum(counts)))
        lengths = np.diff(np.concatenate(([0], total[np.searchsorted(ends, word_ends, "right")])))
        return self._bytes(flat, lengths)

    def _bytes(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece as the pieces of their bytes."""
        strange = np.flatnonzero(flat >= self.size)
        if not len(strange):
            return flat, lengths
        if (self.byte_ids < 0).any():
            flat[strange] = self.unknown
            return flat, lengths
        spelled = [chr(c).encode() for c in (flat[strange] - self.size).tolist()]
        width = np.ones(len(flat), np.int64)
        width[strange] = [len(s) for s in spelled]
        out = np.repeat(flat, width)
        begin = np.cumsum(width) - width
        out[ragged(begin[strange], width[strange])] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
        total = np.concatenate(([0], np.cumsum(width)))
        return out, np.diff(total[np.concatenate(([0], np.cumsum(lengths)))])

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over segments of symbols (none empty): (flat tokens, tokens per segment)."""
        out, counts = np.full(len(symbols), -1, np.int64), sizes.copy()
        begin = np.cumsum(sizes) - sizes
        single = sizes == 1
        out[begin[single]] = symbols[begin[single]]
        for i in np.flatnonzero(sizes > LONG).tolist():
            found = self.merge_long(symbols[begin[i] : begin[i] + sizes[i]].tolist())
            out[begin[i] : begin[i] + len(found)], counts[i] = found, len(found)
        live = np.flatnonzero((sizes > 1) & (sizes <= LONG))
        tokens, size = symbols[ragged(begin[live], sizes[live])], sizes[live]
        pair = np.full(len(tokens), -1, np.int64)  # the pair that begins at a symbol; none at a segment's last
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(size) - 1] = False
        inner = np.flatnonzero(inner)
        pair[inner] = self.merges.get((tokens[inner] << BITS) | tokens[inner + 1])
        while len(live):
            first = np.cumsum(size) - size
            rank = self.rank[pair]
            least = np.minimum.reduceat(rank, first)
            done = least >= NEVER
            if done.any():
                out[ragged(begin[live[done]], size[done])] = tokens[np.repeat(done, size)]
                counts[live[done]] = size[done]
                stay = ~np.repeat(done, size)
                tokens, pair, rank = tokens[stay], pair[stay], rank[stay]
                live, size, least = live[~done], size[~done], least[~done]
                if not len(live):
                    break
                first = np.cumsum(size) - size
            at = np.flatnonzero(rank == np.repeat(least, size))
            fresh = np.ones(len(at), bool)  # begins a run of neighbouring pairs: those at even places of a run don't overlap
            fresh[1:] = at[1:] != at[:-1] + 1
            places = np.arange(len(at))
            at = at[(places - np.maximum.accumulate(np.where(fresh, places, 0))) % 2 == 0]
            owner = np.searchsorted(first, at, "right") - 1
            leftmost = np.ones(len(at), bool)
            leftmost[1:] = owner[1:] != owner[:-1]
            chosen = leftmost | ~self.one_by_one[self.made[pair[at]]]
            # of a segment whose leftmost pair must merge alone, nothing else merges
            alone = np.zeros(len(live), bool)
            alone[owner[leftmost & self.one_by_one[self.made[pair[at]]]]] = True
            chosen &= leftmost | ~alone[owner]
            at, owner = at[chosen], owner[chosen]
            tokens[at] = self.made[pair[at]]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, pair = tokens[keep], pair[keep]
            at = at - np.arange(len(at))
            size = size - np.bincount(owner, minlength=len(live))
            ends = np.cumsum(size)
            pair[at] = -1
            right = at[at + 1 < ends[owner]]
            left = at[at > (ends - size)[owner]] - 1
            for side in (right, left):
                pair[side] = self.merges.get((tokens[side] << BITS) | tokens[side + 1])
        return out[out >= 0], counts

    def merge_long(self, tokens: list[int]) -> list[int]:
        """One long segment's symbols merged with a heap: n log n."""
        n = len(tokens)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.pairs.get((tokens[i] << BITS) | tokens[j])) is not None:
                heapq.heappush(heap, (found[0], i, tokens[i], tokens[j], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in tokens if t >= 0]

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text) of texts whose bytes lie one after another."""
        self._trim()
        text, first, size, counts = self.cut(data, offsets)
        parts = range(0, len(first), SIDE)
        slots = self._slots([(text, first[a : a + SIDE], size[a : a + SIDE]) for a in parts])
        lengths = self.lengths[slots]
        total = np.concatenate(([0], np.cumsum(lengths)))
        return self.flat[ragged(self.starts[slots], lengths)], np.diff(total[np.concatenate(([0], np.cumsum(counts)))])

    def decode_slice(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all decoded texts, offsets) of ids whose texts follow one another."""
        data, width = self.spelled.join(ids)
        total = np.concatenate(([0], np.cumsum(width)))
        begin = np.concatenate(([0], np.cumsum(counts)))
        offsets = total[begin]
        first = begin[:-1][counts > 0]
        marked = offsets[:-1][counts > 0][self.leading[ids[first]]]
        keep = np.ones(len(data), bool)
        keep[marked] = False
        return data[keep], offsets - np.searchsorted(marked, offsets)

    def decode(self, ids: list[int]) -> bytes:
        """The decoded text in UTF-8; bytes that are no character become U+FFFD each."""
        data, _ = self.decode_slice(np.array(ids, np.int64), np.array([len(ids)]))
        text = data.tobytes().decode("utf-8", "surrogateescape")
        return "".join("�" if "\udc80" <= c <= "\udcff" else c for c in text).encode() if any("\udc80" <= c <= "\udcff" for c in text) else data.tobytes()


class Strings:
    """Byte strings by number, joined many at once."""

    def __init__(self, strings: list[bytes]):
        self.width = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.width) - self.width
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.width[numbers]
        return self.data[ragged(self.first[numbers], width)], width


def encoder(path: str) -> PieceBPE:
    """One encoder per worker and file."""
    if path not in _loaded:
        _loaded[path] = PieceBPE(path)
    return _loaded[path]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return with_clear_names(docs, key, text).select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string"))


def encode(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row.  No shuffle."""
    path = file_path(model)

    def run(batch: pa.RecordBatch):
        pieces = encoder(path)
        for rows, data, offsets in text_slices(batch, 1):
            ids, counts = pieces.encode_slice(data, offsets)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield [rows.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))]

    return arrow_map(_rows(docs, key, text), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of each row of ``encode``."""
    path = file_path(model)

    def run(batch: pa.RecordBatch):
        pieces = encoder(path)
        yield [batch.column(0), [pieces.decode(x or []).decode() for x in batch.column(1).to_pylist()]]

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, model: str = MODEL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass; digests of both instead of ids and texts."""
    path = file_path(model)

    def run(batch: pa.RecordBatch):
        pieces = encoder(path)
        for rows, data, offsets in text_slices(batch, 1):
            ids, counts = pieces.encode_slice(data, offsets)
            decimals, width = pieces.decimals.join(ids)
            ends = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(counts)))]
            decoded, edges = pieces.decode_slice(ids, counts)
            a = [sha256(decimals[x : max(x, y - 1)]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            b = [sha256(decoded[x:y]).hexdigest() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield [rows.column(0), counts, a, b]

    return arrow_map(_rows(docs, key, text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
