"""Operator 4, WARC: Zstandard archives with a dictionary frame, one frame per record.

An archive starts with a skippable frame that holds the dictionary (itself one Zstandard frame); each
record is a Zstandard frame of its own, with checksum.  Pages with equal payloads are stored once: the
smallest page_id holds the response, the others are revisit records that refer to it.

Plan: digests and the first page of each repeated digest come from one aggregate over (digest, page_id)
only; payloads move once, by page_id, to the tasks that write archives.  A hot digest meets the written
table of firsts in a join whose both sides Spark can split.  Every archive has a dictionary, trained on its first records (at
most TRAIN_BYTES) or, where those are few, made of them; it changes sizes, never contents.

Each attempt of a task writes files of its own names; the stored listing names those of finished tasks, and only they are read.

Defined results: null html is an empty payload; a null url has no target; pages with a null page_id are responses;
equal rows are kept as records of their own (the first page_id's are all responses); an empty table gives no archive; a very long
payload is one record of one frame; extra columns are not read.
"""

from __future__ import annotations

import struct
from base64 import b32encode
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, attempt, filesystem, publish, shared_folder, stored, table, with_clear_names

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
LEVEL, FILE_BYTES, DICTIONARY_BYTES, TRAIN_BYTES, READ = 3, 64 << 20, 64 << 10, 4 << 20, 16 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + quote(url, safe="/:?#[]@!$&'()*+,;=%-._~"))
    fields.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of the first records; where they are too few to train one, they are its content themselves."""
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
        except zstandard.ZstdError:  # samples that have nothing in common
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Collects records; trains the dictionary when TRAIN_BYTES have come or at the end."""

    def __init__(self):
        self.waiting, self.size, self.parts, self.compressor = [], 0, [], None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if self.compressor:
            self._put(data)
            return
        self.waiting.append(data)
        if self.size >= TRAIN_BYTES:
            self._train()

    def _put(self, data: bytes) -> None:
        self.parts.append(self.compressor.compress(data))
        self.written += len(self.parts[-1])

    def _train(self) -> None:
        self.written = 0
        dictionary = dictionary_of([x[: 16 << 10] for x in self.waiting])
        frame = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
        self.parts.append(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        for data in self.waiting:
            self._put(data)
        self.waiting = []

    def full(self) -> bool:
        return bool(self.compressor) and self.written >= FILE_BYTES

    def finish(self) -> bytes:
        if not self.compressor:
            self._train()
        return b"".join(self.parts)


def frames(data: bytes):
    """(offset, content) of each record's frame."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        if struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        begin, one, out = at, reader.decompressobj(), []
        while not one.eof:
            piece = data[at : at + READ]
            if not piece:
                raise ValueError(f"the frame at {begin} is cut short")
            out.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield begin, b"".join(out)


def parse(content: bytes) -> dict:
    """Fields of one record; raises ValueError where headers, lengths or digests don't hold."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length and record end disagree")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    own = dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:])
    size, kind = int(own[b"content-length"]), fields["warc-type"]
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest_of(payload) != stated):
        raise ValueError("payload and its length or digest disagree")
    if kind == "revisit" and (payload or "warc-refers-to" not in fields) or kind not in ("response", "revisit"):
        raise ValueError(f"bad {kind} record")
    number = lambda uri: None if uri is None or uri == "<urn:page:null>" else int(uri[len("<urn:page:") : -1])
    return {"page_id": number(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": stated, "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): which page's record refers to which response.  Payloads of fewer than ``least`` bytes are never revisits."""
    rows = with_clear_names(pages, key, url, html).select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    known = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least)).select("page_id", F.unhex(F.sha1("payload")).alias("digest"))
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("other")).where("other > refers_to").drop("other")
    revisits = known.join(stored(firsts, "firsts"), "digest").where("page_id > refers_to").distinct()
    return rows.withColumn("digest", F.unhex(F.sha1("payload"))).join(revisits, ["page_id", "digest"], "left").drop("digest")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records of ``plan_records``; the listing of the archives as a stored table (file)."""

    def run(batches):
        count, writer = 0, None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or ArchiveWriter()
                writer.add(record(page_id, url, payload, refers_to))
                if writer.full():
                    yield out(count, writer)
                    count, writer = count + 1, None
        if writer:
            yield out(count, writer)

    def out(count: int, writer: ArchiveWriter) -> pa.RecordBatch:
        name = f"{folder}/pages-{attempt()}-{count:04d}.warc.zst"
        publish(name, writer.finish())
        return pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return stored(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "file string"), "archives")


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the listed archives; the payload of responses on request."""
    listed = files.select("file").repartitionByRange(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * payloads]

    def run(batch: pa.RecordBatch):
        for name in batch.column(0).to_pylist():
            store, place = filesystem(name)
            with store.open_input_stream(place, compression=None) as f:
                data = f.read()
            found = []
            for offset, content in frames(data):
                r = parse(content)
                found.append([r[n] for n in names] + [name, offset])
                if len(found) == 500:
                    yield list(zip(*found, strict=True))
                    found = []
            if found:
                yield list(zip(*found, strict=True))

    return arrow_map(listed, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, " + "payload binary, " * payloads + "file string, offset long")


#: DuckDB SQL for op4_warc's rows.  A SHA-1 of 40 hex digits is 8 times 5 digits, each 4 letters of base32.
ORACLE_SQL = """
WITH rows AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
sums AS (SELECT page_id, url, strlen(payload) AS payload_bytes, payload, sha1(payload) AS hex FROM rows),
firsts AS (SELECT *, CASE WHEN page_id IS NOT NULL THEN min(page_id) OVER (PARTITION BY payload) END AS first FROM sums)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, url
FROM firsts
"""


def op4_warc(spark, sf_dir: str) -> DataFrame:
    files = write_archives(plan_records(table(spark, sf_dir, "pages")), shared_folder(spark, "warc"))
    return read_archives(files).drop("file", "offset")
