"""Operator 7, media columns: content-addressed payloads in tar shards.

A text's bytes, padded with zeros to a positive multiple of 64, are stored as an 8-bit grey PNG of 64
samples a row.  Tasks write tar shards as they read (no shuffle of texts); a shard holds each content
once, named by its digest.  Rows carry digest, offset and length.  Copies of a content in
other shards stay unreferenced: every row of a digest refers to the first place by (shard, offset), so each
content is read once.

``media_metadata`` fills width, height and depth from the first HEADER bytes of each payload, by range reads of
those bytes alone; ``media_features`` reads whole payloads.

Defined results: null and empty texts are 64 zero bytes; equal texts share digest and features; repeated rows
and null doc_ids are kept; an empty table gives no shards; very long texts are one payload each, stored and read whole; extra columns,
whatever their names, are not read.
"""

from __future__ import annotations

import struct
import tarfile
from hashlib import sha256
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _rows
from .common import arrow_map, attempt, filesystem, publish, shared_folder, stored, table, text_slices

ROW, LEVEL, SHARD_BYTES, HEADER = 64, 6, 64 << 20, 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(text: bytes) -> bytes:
    """Zeros up to a positive multiple of ROW."""
    return text.ljust(max(ROW, -(-len(text) // ROW) * ROW), b"\0")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image, ROW samples wide."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line's filter byte is 0
    lines[:, 1:] = rows
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, colour type) from the first HEADER bytes."""
    if len(data) < HEADER or data[:8] != SIGNATURE or data[12:16] != b"IHDR" or crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", data[16:26])


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` wrote."""
    width, height, bits, colour = png_header(data)
    at, packed = HEADER, []
    while True:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IEND":
            break
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if bits != 8 or colour or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey image")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and entropy of the samples and share of zeros."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n[n > 0] / len(payload)
    return f"mean={float((n * np.arange(256)).sum() / len(payload)):.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};zeros={int(n[0])}"


class Shard:
    def __init__(self):
        self.parts, self.at, self.places = [], 0, {}

    def put(self, digest: str, payload: bytes) -> tuple[int, int]:
        """(offset, length) of the content's bytes."""
        if digest not in self.places:
            data = to_png(payload)
            entry = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
            entry.size = len(data)
            head = entry.tobuf(tarfile.USTAR_FORMAT)
            self.places[digest] = (self.at + len(head), len(data))
            self.parts += [head, data, b"\0" * (-len(data) % 512)]
            self.at += len(head) + len(data) + -len(data) % 512
        return self.places[digest]

    def finish(self) -> bytes:
        return b"".join([*self.parts, b"\0" * 1024])


def write_shards(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, digest, shard, offset, length) of each row, from the written index."""
    schema = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"

    def run(batches):
        count, shard, waiting = 0, Shard(), []

        def close() -> pa.RecordBatch:
            name = f"{folder}/shard-{attempt()}-{count:04d}.tar"
            publish(name, shard.finish())
            ids, sizes, digests, places = zip(*waiting, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([name] * len(ids)), pa.array([p[0] for p in places]), pa.array([p[1] for p in places])], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])

        for batch in batches:
            for rows, data, offsets in text_slices(batch, 1):
                whole = data.tobytes()
                for doc_id, a, b in zip(rows.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    payload = pad(whole[a:b])
                    digest = sha256(payload)
                    waiting.append((doc_id, b - a, digest.digest(), shard.put(digest.hexdigest(), payload)))
                    if shard.at >= SHARD_BYTES:
                        yield close()
                        count, shard, waiting = count + 1, Shard(), []
        if waiting:
            yield close()

    return stored(_rows(docs, key, text).mapInArrow(run, schema), "media-index")


def contents(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): the place that stands for each content."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")


def _by_shard(places: DataFrame) -> DataFrame:
    return places.select("digest", "shard", "offset", "length").repartition("shard").sortWithinPartitions("shard", "offset")


class Ranges:
    """Range reads; one open shard at a time."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, shard: str, offset: int, size: int) -> bytes:
        if shard != self.name:
            store, place = filesystem(shard)
            self.name, self.file = shard, store.open_input_file(place)
        return self.file.read_at(size, offset)


def media_metadata(index: DataFrame) -> DataFrame:
    """(digest, width, height, bits) from header-only range reads."""

    def run(batch: pa.RecordBatch):
        ranges, found = Ranges(), []
        for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            found.append(png_header(ranges.read(shard, offset, min(HEADER, length)))[:3])
        if found:
            yield [batch.column(0), *zip(*found, strict=True)]

    return arrow_map(_by_shard(contents(index)), run, "digest binary, width int, height int, bits int")


def media_features(index: DataFrame) -> DataFrame:
    """(digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height) from whole payloads."""

    def run(batch: pa.RecordBatch):
        ranges, found = Ranges(), []
        for shard, offset, length in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data = ranges.read(shard, offset, length)
            width, height, _, _ = png_header(data[:HEADER])
            payload = from_png(data)
            if len(payload) != width * height:
                raise ValueError("header and payload disagree")
            found.append((len(payload), sha256(payload).hexdigest(), crc32(payload[-64:]), len(data), sha256(data).hexdigest(), f"grey {width}x{height};{feature(payload)}"))
        if found:
            yield [batch.column(0), *zip(*found, strict=True)]

    return arrow_map(_by_shard(contents(index)), run, "digest binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media(spark, sf_dir: str) -> DataFrame:
    index = write_shards(table(spark, sf_dir, "documents"), shared_folder(spark, "media"))
    return index.select("doc_id", "n_bytes", "digest").join(media_features(index), "digest").join(media_metadata(index), "digest").drop("digest")
