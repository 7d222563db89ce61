"""Operator 6, token-ID output: Simple-8b words in files with per-block offsets.

A 64-bit word holds a selector in its low 4 bits and 60 bits of ids: selector s holds COUNTS[s] ids of
WIDTHS[s] bits each.  Selector 0 is the escape: the next word is one id of up to 64 bits, as it is.
Blocks of BLOCK ids are coded apart, so a block can be decoded alone and all of a file's blocks can be
coded side by side.  A block's last word may be padded with zeros; the block's id count ends it.

File: MAGIC, words (little-endian unsigned 64 bit), then the tail: word offset of each block, doc_id and
n_tokens of each document, and six counts with MAGIC again.  Ids of documents lie one after another in
ascending doc_id order; the listing of the files follows that order.

Texts are encoded where they are read; only ids (of two bytes each where the vocabulary allows) are exchanged, by ranges of doc_id
that approximate percentiles give (any ranges are right; these are even).  Each task writes files of about FILE_BYTES under names of its
own attempt, and only those that a finished task lists are read.  The listing is a stored table; the driver keeps one number per range.

Defined results: null and empty texts have the end id alone; rows with equal doc_id are kept, each as a
document, in the order of their ids' crc32 (a doc_id that many rows share is spread over ranges by it); a null doc_id sorts
first; an empty table gives no files and no rows; extra columns, whatever their names, are not read.  A very long text is one document of one file, whatever its size.
"""

from __future__ import annotations

import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, _rows, encoded_slices, encoder, file_path
from .common import arrow_map, attempt, filesystem, publish, shared_folder, stored, table

MAGIC, BLOCK, END_ID = b"S8BIDS02", 1024, 1
#: Coded bytes that end a file; ids coded at once; blocks decoded at once.
FILE_BYTES, CODED, DECODED = 32 << 20, 1 << 20, 1 << 10
#: The selectors' counts and widths, the escape first.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: An id below _LIMITS[i] needs selector i + 1 at least; 15 stands for the escape.
_LIMITS = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)
_BITS = (np.searchsorted(_LIMITS, np.arange(1 << 17, dtype=np.uint64), "right") + 1).astype(np.uint8)


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, index of each block's first word) of non-negative ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids = np.ascontiguousarray(ids, np.uint64)
    # the narrowest selector that holds each id, by blocks with zeros behind them
    fit = np.zeros((-(-n // block), block + 64), np.uint8)
    bits = _BITS[ids] if int(ids.max()) < len(_BITS) else (np.searchsorted(_LIMITS, ids, "right") + 1).astype(np.uint8)
    padded_bits = np.zeros(len(fit) * block, np.uint8)
    padded_bits[:n] = bits
    fit[:, :block] = padded_bits.reshape(-1, block)
    selector = np.zeros(fit.shape, np.uint8)
    widest, have = fit, 1
    for s in range(len(COUNTS) - 1, 0, -1):  # the most needed by any of the next COUNTS[s] ids
        while have < COUNTS[s]:
            step = min(have, int(COUNTS[s]) - have)
            moved = np.zeros_like(widest)
            moved[:, :-step] = widest[:, step:]
            widest, have = np.maximum(widest, moved), have + step
        fits = widest[:, :block] <= s
        if not fits.any():  # more ids of fewer bits fit nowhere either
            break
        selector[:, :block] = np.where(fits, np.uint8(s), selector[:, :block])
    selector = selector[:, :block].reshape(-1)[:n]
    take = COUNTS.astype(np.uint8)[selector]
    at = np.arange(0, n, block)
    lasts = np.minimum(at + block, n)
    first = np.zeros(n, bool)
    while len(at):  # one step of all blocks at once
        first[at] = True
        at = at + take[at]
        on = at < lasts
        at, lasts = at[on], lasts[on]
    starts = np.flatnonzero(first)
    chosen = selector[starts]
    width = np.where(chosen == 0, 2, 1)
    where = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    held = np.diff(np.append(starts, n))
    place = np.arange(n, dtype=np.uint64) - np.repeat(starts.astype(np.uint64), held)
    shift = np.uint64(4) + place * np.repeat(WIDTHS.astype(np.uint64)[chosen], held)
    words[where] = np.bitwise_or.reduceat(ids << shift, starts) | chosen
    escaped = np.flatnonzero(chosen == 0)
    words[where[escaped]], words[where[escaped] + 1] = 0, ids[starts[escaped]]
    return words, where[np.searchsorted(starts, np.arange(0, n, block))]


def decode_ids(words: np.ndarray, blocks: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of consecutive blocks."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():  # a raw word follows each escape; runs are walked, since raw words may look like escapes
        i = 0
        zeros = np.flatnonzero(selector == 0)
        for z in zeros.tolist():
            if z >= i:
                raw[z + 1] = True
                i = z + 2
    selector[raw] = 1
    count = np.where(raw, 0, COUNTS[selector])
    owner = np.searchsorted(blocks, np.arange(len(words)), "right") - 1
    before = np.cumsum(count) - count
    place = before - before[blocks][owner] + owner * block
    out = np.zeros(len(blocks) * block + 64, np.uint64)
    for s in np.unique(selector[~raw]):
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[place[mine]] = words[mine + 1]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        limit = np.minimum((owner[mine] + 1) * block, n)
        for j in range(COUNTS[s]):
            fit = place[mine] + j < limit
            out[place[mine][fit] + j] = (words[mine][fit] >> np.uint64(4 + j * int(WIDTHS[s]))) & mask
    return out[:n]


class FileWriter:
    """Codes whole blocks as ids come; holds the coded words of one file."""

    def __init__(self):
        self.rest, self.waiting, self.words, self.blocks, self.docs, self.counts, self.n = [], 0, [], [], [], [], 0
        self.length, self.nulls = 0, 0

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        """More documents; those without a doc_id come first."""
        self.nulls += doc_ids.null_count
        self.docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False)), self.counts.append(counts)
        self.n += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= CODED:
            self._code(self.waiting // BLOCK * BLOCK)

    def _code(self, n: int) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint16)
        words, blocks = encode_ids(ids[:n])
        self.words.append(words.astype("<u8", copy=False).tobytes())
        self.blocks.append(blocks + self.length)
        self.length += len(words)
        self.rest, self.waiting = [ids[n:]], len(ids) - n

    def finish(self) -> bytes:
        self._code(self.waiting)
        blocks, docs, counts = (np.concatenate(x).astype("<i8") for x in (self.blocks, self.docs, self.counts))
        return b"".join([MAGIC, *self.words, blocks.tobytes(), docs.tobytes(), counts.tobytes(), struct.pack("<6q", self.length, len(blocks), len(docs), self.nulls, self.n, BLOCK), MAGIC])


def read_file(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids); checks marks and lengths."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a Simple-8b id file")
    length, blocks, docs, nulls, n, block = struct.unpack("<6q", data[-56:-8])
    if len(data) != 64 + 8 * (length + blocks + 2 * docs):
        raise ValueError("a Simple-8b id file of the wrong length")
    words = np.frombuffer(data, "<u8", length, 8)
    tail = np.frombuffer(data, "<i8", blocks + 2 * docs, 8 + 8 * length)
    at, counts = tail[:blocks], tail[blocks + docs :]
    if counts.sum() != n:
        raise ValueError("document lengths don't add up")
    out = []
    for b in range(0, blocks, DECODED):
        end = min(b + DECODED, blocks)
        own = words[at[b] : at[end] if end < blocks else length]
        ids = decode_ids(own, at[b:end] - at[b], min(n, end * block) - b * block, block)
        out.append(ids.astype(np.uint32) if not len(ids) or int(ids.max()) >> 32 == 0 else ids)
    return pa.array(tail[blocks : blocks + docs], mask=np.arange(docs) < nulls), counts, np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_ids(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order; the listing (part, before, file, n): ids in the part's earlier files and in this one."""
    path, spark = file_path(vocabulary), docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    source = _rows(docs, key, text).toDF("doc_id", "text")
    marks = ", ".join(f"{i / parts}" for i in range(1, parts))
    found = source.agg(F.expr(f"percentile_approx(doc_id, array({marks}), 20 * {parts})")).first()[0] if parts > 1 else None
    bounds = np.array(found or [], np.int64)  # one number per range

    def encode(batch: pa.RecordBatch):
        unit = "<u2" if max(encoder(path).vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"
        for rows, ids, counts in encoded_slices(batch, 1, path, end_id):
            raw = ids.astype(unit)
            offsets = np.concatenate(([0], np.cumsum(counts))) * raw.itemsize
            own = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            view = memoryview(raw).cast("B")
            tie = np.array([crc32(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)
            yield [rows.column(0), tie, range_of(rows.column(0), tie, bounds), np.full(len(counts), raw.itemsize), own]

    rows = arrow_map(source, encode, "doc_id long, tie long, part int, unit int, ids binary").repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "tie", "ids")

    def run(batches):
        from pyspark import TaskContext

        writer, part, before, k = FileWriter(), TaskContext.get().partitionId(), 0, 0

        def close():
            name = f"{folder}/ids-{attempt()}-{k:05d}.s8b"
            publish(name, writer.finish())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before]), pa.array([name]), pa.array([writer.n])], ["part", "before", "file", "n"])

        for batch in batches:
            for rows in _chunks(batch):
                own, unit = rows.column(2), rows.column(1)[0].as_py()
                edge = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1 + own.offset)[own.offset :].astype(np.int64)
                ids = np.frombuffer(own.buffers()[2], np.uint8)[edge[0] : edge[-1]].view(f"<u{unit}")
                writer.add(rows.column(0), np.diff(edge) // unit, ids)
                if 8 * writer.length + 2 * writer.waiting >= file_bytes:
                    yield close()
                    before, k, writer = before + writer.n, k + 1, FileWriter()
        if writer.docs:
            yield close()

    return stored(rows.select("doc_id", "unit", "ids").mapInArrow(run, "part int, before long, file string, n long"), "id-files")


def range_of(doc_ids: pa.Array, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each row: ascending by (doc_id, tie).  A doc_id that several bounds name is dealt over their ranges by its tie."""
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(bounds, ids), np.searchsorted(bounds, ids, "right")
    part = low + ((high - low + 1) * tie >> 32)
    return np.where(doc_ids.is_null().to_numpy(zero_copy_only=False), 0, part).astype(np.int32)


def _chunks(batch: pa.RecordBatch, most: int = 1 << 7):
    for a in range(0, len(batch), most):
        yield batch.slice(a, most)


def read_ids(files: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids or ids_crc32) of each document in the listed files."""
    spark = files.sparkSession
    base, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # at most spark.sql.shuffle.partitions rows
        base[r.part], total = total, total + r.n
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batch: pa.RecordBatch):
        for part, before, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, place = filesystem(name)
            with store.open_input_stream(place, compression=None) as f:
                doc_ids, counts, ids = read_file(f.read())
            edge = np.concatenate(([0], np.cumsum(counts)))
            if digest:
                view = memoryview(ids.astype("<u4", copy=False)).cast("B")
                last = [crc32(view[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            else:
                last = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int64)))
            yield [doc_ids, edge[:-1] + base[part] + before, counts, last]

    listed = files.select("part", "before", "file").repartitionByRange(parts, "part", "before")
    return arrow_map(listed, run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))


def op6_token_ids(spark, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents"), shared_folder(spark, "ids")), digest=True)
