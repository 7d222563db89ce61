"""Operator 5, packing: windows filled by lexical neighbours from a sharded BM25 index.

1. Every document is encoded once; its ids (16 bit) are written to a table, with each task's document
   frequencies of terms (token ids) as one more row.  Their sum over all documents gives the idf; it has one
   entry per vocabulary id, which bounds what the driver and the tasks hold.
2. The written table is read in shards of about SHARD_TOKENS ids.  Each shard gets an inverted index with
   BM25 weights from the global statistics.  A seed document fills windows; the rest of its last window is filled by
   its best unused neighbours in the index, cut where the window ends, and the cut document is the next seed.
3. What is left at a shard's end is cut at powers of two, which need no padding.

Terms that more than half of all documents have get an idf of 0 and are not looked up.  No shuffle but for the sums.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; a null doc_id is
kept; an empty table gives no rows; extra columns, whatever their names, are not read; a very long text fills windows of its own and is never cut short; of equal scores the earlier
document comes first, and where no unused document shares a term the first unused one fills; shards follow the order of the written table, so sequence ids depend on how the input is split, while the
pieces always cover each document exactly once.
"""

from __future__ import annotations

import base64
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _rows, file_path
from .common import stored, table, text_slices

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
WINDOW, END_ID, SHARD_TOKENS, K1, B = 2048, 1, 1 << 20, 1.2, 0.75
_loaded: dict = {}


def _encoders(vocabulary: str, ranks: str):
    """The byte-level encoder, the one for texts with special tokens, and their mark."""
    if (vocabulary, ranks) not in _loaded:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(file_path(vocabulary))
        full.no_padding(), full.no_truncation()
        with open(file_path(ranks), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        marks = tuple(x.content for x in full.get_added_tokens_decoder().values())
        _loaded[vocabulary, ranks] = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}), full, marks, full.get_vocab_size()
    return _loaded[vocabulary, ranks]


def token_ids(texts: list[str | None], vocabulary: str = VOCABULARY, ranks: str = RANKS) -> list[list[int]]:
    """Ids as the tokenizers library gives them, without special tokens added."""
    fast, full, marks, _ = _encoders(vocabulary, ranks)
    return [full.encode(t, add_special_tokens=False).ids if any(m in t for m in marks) else fast.encode_ordinary(t) for t in (t or "" for t in texts)]


def tokenize(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, df): a row per document, ids as unsigned 16-bit; and a row per task with its frequencies in df,
    whose last two entries are its documents and ids."""
    schema = "doc_id long, ids binary, df binary"

    def run(batches):
        size = _encoders(vocabulary, ranks)[3]
        if size > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        df = np.zeros(size + 2, np.int64)
        for batch in batches:
            for rows, _, _ in text_slices(batch, 1):
                found = []
                for ids in token_ids(rows.column(1).to_pylist(), vocabulary, ranks):
                    ids.append(END_ID)
                    own = np.array(ids, np.uint16)
                    df[np.unique(own)] += 1
                    df[size] += 1
                    df[size + 1] += len(own)
                    found.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())], ["doc_id", "ids", "df"])
        if df[size]:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([df.tobytes()])], ["doc_id", "ids", "df"])

    return _rows(docs, key, text).mapInArrow(run, schema)


def frequencies(tokens: DataFrame) -> np.ndarray:
    """The sum of all tasks' frequencies: as many entries as the vocabulary has, and two."""

    def run(batches):
        total = None
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = np.frombuffer(x, np.int64)
                total = own.copy() if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(np.full(len(at), len(total)))], ["at", "n", "size"])

    rows = tokens.where("df IS NOT NULL").select("df").mapInArrow(run, "at long, n long, size long").groupBy("at").agg(F.sum("n").alias("n"), F.max("size").alias("size")).toPandas()
    if not len(rows):
        return np.zeros(2, np.int64)
    out = np.zeros(int(rows["size"].iloc[0]), np.int64)
    out[rows["at"]] = rows["n"]
    return out


class Index:
    """BM25 postings of one shard, by term; documents without terms of positive idf have none."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        lengths = np.array([len(d) for d in docs], np.int64)
        keys = (np.concatenate(docs).astype(np.int64) << 20) | np.repeat(np.arange(len(docs)), lengths)
        keys = np.sort(keys[idf[keys >> 20] > 0])
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(keys)))
        term, self.doc = keys[new] >> 20, (keys[new] & 0xFFFFF).astype(np.int64)
        norm = K1 * (1 - B + B * lengths / max(mean_length, 1e-9))
        self.weight = idf[term] * count * (K1 + 1) / (count + norm[self.doc])
        self.begin = np.searchsorted(term, np.arange(len(idf) + 1))
        self.idf, self.n = idf, len(docs)

    def scores(self, query: np.ndarray) -> np.ndarray | None:
        """BM25 of each document; None where the query has no term of positive idf."""
        terms = np.unique(query)
        terms = terms[self.idf[terms] > 0].astype(np.int64)
        if not len(terms):
            return None
        first, size = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        ends = np.cumsum(size)
        at = np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def neighbours(index: Index, query: np.ndarray, unused: np.ndarray, first: int = 64):
    """Unused documents that share a term with the query, best first, of equal ones that of the smaller number; ordered as far as asked for."""
    scores = index.scores(query)
    if scores is None:
        return
    left = np.flatnonzero((scores > 0) & unused)
    while len(left):
        own = scores[left]
        most = own >= np.partition(own, len(own) - first)[len(own) - first] if len(own) > first else np.ones(len(own), bool)
        top, left, first = left[most], left[~most], 4 * first
        yield from top[np.lexsort((top, -scores[top]))].tolist()


def fill(docs: list[np.ndarray], idf: np.ndarray, mean_length: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each id of the shard once."""
    index = Index(docs, idf, mean_length)
    unused = np.ones(len(docs), bool)
    sequences: list[list[tuple[int, int, int]]] = []
    cursor, free, seed, start = 0, 0, -1, 0
    while True:
        if seed < 0:
            while cursor < len(docs) and not unused[cursor]:
                cursor += 1
            if cursor == len(docs):
                break
            seed, start = cursor, 0
            unused[seed] = False
        n = len(docs[seed])
        while n - start >= window:
            sequences.append([(seed, start, window)])
            start += window
        if start == n:
            seed = -1
            continue
        pieces, space = [(seed, start, n - start)], window - (n - start)
        near = neighbours(index, docs[seed], unused)
        seed = -1
        while space:
            best = next(near, -1)
            if best < 0:  # nothing unused shares a term: the first unused document
                while free < len(docs) and not unused[free]:
                    free += 1
                if free == len(docs):
                    break
                best = free
            unused[best] = False
            take = min(space, len(docs[best]))
            pieces.append((best, 0, take))
            space -= take
            if take < len(docs[best]):
                seed, start = best, take
        if space:
            sequences += halved(pieces)
        else:
            sequences.append(pieces)
    return sequences


def halved(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cuts a short sequence into sequences of falling powers of two."""
    total, out, k, used = sum(p[2] for p in pieces), [], 0, 0
    for bit in reversed(range(total.bit_length())):
        if not total >> bit & 1:
            continue
        left, own = 1 << bit, []
        while left:
            doc, start, length = pieces[k]
            take = min(left, length - used)
            own.append((doc, start + used, take))
            left, used = left - take, used + take
            if used == length:
                k, used = k + 1, 0
        out.append(own)
    return out


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS, window: int = WINDOW, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """A row per piece: (doc_id, start, length, ids or ids_crc32, doc_tokens, sequence_id, offset)."""
    tokens = stored(tokenize(docs, vocabulary, ranks, key, text), "tokens")
    total = frequencies(tokens)
    documents, ids_total, df = int(total[-2]), int(total[-1]), total[:-2]
    idf = np.where(df > 0, np.maximum(np.log((documents - df + 0.5) / (df + 0.5)), 0), 0)
    mean_length = ids_total / max(documents, 1)
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches):
        from pyspark import TaskContext

        sequence, waiting, size = TaskContext.get().partitionId() << 33, [], 0

        def shard() -> pa.RecordBatch:
            nonlocal sequence
            own = [np.frombuffer(x, np.uint16) for _, x in waiting]
            rows = []
            for pieces in fill(own, idf, mean_length, window):
                offset = 0
                for doc, start, length in pieces:
                    ids = own[doc][start : start + length]
                    rows.append((waiting[doc][0], start, length, crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32), len(own[doc]), sequence, offset))
                    offset += length
                sequence += 1
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", last.split()[0], "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append((doc_id, ids))
                size += len(ids) // 2
                if size >= SHARD_TOKENS or len(waiting) >= 1 << 20:
                    yield shard()
                    waiting, size = [], 0
        if waiting:
            yield shard()

    return tokens.where("df IS NULL").select("doc_id", "ids").mapInArrow(run, f"doc_id long, start long, length long, {last}, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), digest=True)
