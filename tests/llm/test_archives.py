import struct
from hashlib import sha256
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from annalist.llm import media, warc
from annalist.llm.common import shared_folder
from tests.llm.conftest import prose

PAGES = "page_id long, url string, html string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/1", "<p>x</p>"), (3, "http://a/é b\r\nX: y", "<p>x</p>"), (9, None, "<p>x</p>"), (4, "u", None), (6, "u", ""), (7, "u", "é" * 5000), (8, "v", "y\r\n\r\nz"), (8, "v", "y\r\n\r\nz"), (None, "v", "<p>x</p>"), (10, "v", "z" * 300_000)]
    return spark.createDataFrame([(*r, "d") for r in rows], PAGES)


def test_warc_round_trip(spark, pages):
    files = warc.write_archives(warc.plan_records(pages), shared_folder(spark, "warc"))
    rows = warc.read_archives(files, payloads=True).collect()
    stored = pages.collect()
    assert len(rows) == len(stored)
    firsts = {}
    for r in stored:
        if r.page_id is not None:
            firsts[r.html or ""] = min(firsts.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in stored:
        payload, first = (r.html or "").encode(), firsts.get(r.html or "")
        again = r.page_id is not None and r.page_id > first
        want.append((r.page_id or 0, len(payload), warc.digest_of(payload), "revisit" if again else "response", first if again else None))
    assert sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == sorted(want, key=str)
    assert {bytes(r.payload) for r in rows if r.payload is not None} == {(r.html or "").encode() for r in stored}
    none = warc.write_archives(warc.plan_records(pages.where("false")), shared_folder(spark, "warc"))
    assert none.count() == 0 and warc.read_archives(none).count() == 0
    for (name,) in files.collect():  # small archives have a dictionary too
        with open(name.removeprefix("file://"), "rb") as f:
            assert struct.unpack("<I", f.read(4))[0] == warc.DICTIONARY_MAGIC
    least = warc.plan_records(pages, least=6).where("refers_to IS NOT NULL")
    assert {r.page_id for r in least.collect()} == {5, 9}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=30))
def test_warc_any_records(payloads):
    """Few, tiny or unlike records still get a dictionary frame and come back."""
    writer = warc.ArchiveWriter()
    records = [warc.record(i, None, p, None) for i, p in enumerate(payloads)]
    for r in records:
        writer.add(r)
    data = writer.finish()
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC and [c for _, c in warc.frames(data)] == records


def test_warc_dictionary_and_damage():
    writer = warc.ArchiveWriter()
    records = [warc.record(i, f"http://h/{i}", prose(i, 600).encode(), None) for i in range(300)]
    for r in records:
        writer.add(r)
    data = writer.finish()
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    assert [c for _, c in warc.frames(data)] == records
    with pytest.raises(Exception):
        list(warc.frames(data[:-5]))
    for bad in (records[0].replace(b"Content-Length: ", b"Content-Length: 1", 1), records[0][:-1], records[0].replace(b"sha1:", b"sha1:A"), b"HTTP/1.1\r\n\r\n", records[0].replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse(bad)


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=400))
def test_png_round_trip(text):
    payload = media.pad(text)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(text)
    data = media.to_png(payload)
    assert media.from_png(data) == payload
    assert media.png_header(data[: media.HEADER])[:3] == (64, len(payload) // 64, 8)


def test_media(spark, docs, empty):
    index = media.write_shards(docs, shared_folder(spark, "media"))
    assert index.count() == docs.count()
    rows = index.join(media.media_features(index), "digest").collect()
    want = []
    for r in docs.collect():
        text = (r.text or "").encode()
        p = media.pad(text)
        want.append((r.doc_id or 0, len(text), len(p), sha256(p).hexdigest(), crc32(p[-64:])))
    assert sorted((r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    head = {bytes(r.digest): (r.width, r.height) for r in media.media_metadata(index).collect()}
    assert all(head[bytes(r.digest)][0] * head[bytes(r.digest)][1] == r.payload_bytes for r in rows)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    none = media.write_shards(empty, shared_folder(spark, "media"))
    assert none.join(media.media_features(none), "digest").count() == 0


def test_query_has_the_headers(spark):
    sf = "/root/testdata/sf0.001"
    rows = media.op7_media(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all((r.width, r.width * r.height, r.bits) == (media.ROW, r.payload_bytes, 8) for r in rows)


def test_shard_is_a_tar(tmp_path):
    import io
    import tarfile

    shard = media.Shard()
    a, b = media.pad(b"one"), media.pad(b"two" * 100)
    places = [shard.put(sha256(x).hexdigest(), x) for x in (a, b, a)]
    data = shard.finish()
    assert places[0] == places[2]
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        assert [media.from_png(t.extractfile(m).read()) for m in t.getmembers()] == [a, b]
        assert [(m.offset_data, m.size) for m in t.getmembers()] == places[:2]
