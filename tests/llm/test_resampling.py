import math
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from annalist.llm import resampling

LOW = {i: i + 32 for i in range(65, 91)}


def plain_features(text, runs):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)], len(words)


def plain(rows, target, share=10, seed=2024, least=20, buckets=10_000, runs=1):
    """(doc_id, n_features, weight, score, rank) by the definition."""
    bucket = lambda f: crc32(f.encode()) % buckets
    docs, words = defaultdict(list), Counter()
    for i, text in rows:
        found, n = plain_features(text, runs)
        docs[i] += found
        words[i] += n
    s = Counter(bucket(f) for found in docs.values() for f in found)
    t = Counter(bucket(f) for text in target for f in plain_features(text, runs)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000.0 * math.log((float(t[b] + 1) * float(all_s + buckets)) / (float(s[b] + 1) * float(all_t + buckets))))
    out = {}
    for i, found in docs.items():
        weight = sum(gain(bucket(f)) for f in found)
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296)))]
    able = sorted((i for i in out if words[i] >= least), key=lambda i: (-out[i][2], i is not None, i or 0))
    ranks = {i: k for k, i in enumerate(able[: len(able) * share // 100], 1)}
    return {i: (*v, ranks.get(i)) for i, v in out.items()}


def taken(df):
    return {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(1, "the quick wizards box9 with 中文 quartz"), (2, None), (3, ""), (4, "Judges JUDGES É é")], "item_id long, text string")


@pytest.mark.parametrize("share, runs, buckets", [(10, 1, 10_000), (50, 2, 10_000), (100, 3, 500)])
def test_equals_definition(docs, target, share, runs, buckets):
    rows, wanted = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    got = taken(resampling.resample(docs, target, share=share, runs=runs, buckets=buckets))
    assert got == plain(rows, wanted, share=share, runs=runs, buckets=buckets)


def test_extra_columns_and_small_chunks(docs, target, monkeypatch):
    """Columns named like the operator's own; many chunks of each bucket group change nothing."""
    clash = docs.withColumnsRenamed({"source": "bucket_group", "index": "weight", "lang": "counts"})
    want = taken(resampling.resample(docs, target))
    monkeypatch.setattr(resampling, "CHUNK", 2)
    assert taken(resampling.resample(clash, target.withColumnRenamed("item_id", "doc_id"))) == want


def test_empty_tables(docs, empty, target):
    assert resampling.resample(empty, target).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert taken(resampling.resample(docs, target.where("false"))) == plain(rows, [])


def test_a_word_that_all_documents_share(spark, target):
    """A hot bucket's chunks lie in several places, ties go to the smaller doc_id, large and negative ids stay exact."""
    rows = [(i * 3 - 50 if i % 7 else i << 40, "the " * (20 + i % 3) + ("quick" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert taken(resampling.resample(docs, target, share=25)) == plain(rows, [r.text for r in target.collect()], share=25)
    chunks = resampling.postings(docs).where("bucket_group >= 0").groupBy("bucket_group").agg({"salt": "approx_count_distinct"}).collect()
    assert max(r[1] for r in chunks) >= 4


def test_crc_of_ranges():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    first = rng.integers(0, 4000, 300)
    size = rng.integers(0, 120, 300)
    size[:3] = [0, 1, 1000]
    want = [crc32(data[a : a + n].tobytes()) for a, n in zip(first.tolist(), size.tolist(), strict=True)]
    assert resampling.crc32_all(data, first, size).tolist() == want
    assert resampling.crc32_all(data, first[:0], size[:0]).tolist() == []


def test_sql_twin(spark, tmp_path):
    import duckdb

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 40))) for i in range(120)], "doc_id long, text string")
    target = spark.createDataFrame([("w1 w2 w3 W3",), ("w5",)], "text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", target)):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    want = {r[0]: tuple(r[1:]) for r in con.sql(resampling.ORACLE_SQL).fetchall()}
    assert taken(resampling.resample(docs, target)) == want
