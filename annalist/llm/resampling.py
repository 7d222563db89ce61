"""Operator 11, importance resampling towards a target: bucket-partitioned inverted postings.

Features are runs of 1 to ``runs`` words, hashed into ``buckets``.  Documents are read once:

1. Each task turns its texts into postings (bucket, document, count), sorted by bucket and cut into chunks of neighbouring buckets.
   Chunks go to the partition of their bucket group; a group is dealt over ``salts`` places, so a bucket that all documents
   have is no hot task.  They are written in that order: the inverted index.
2. Both corpora's counts meet by bucket; each bucket's gain comes from its own two counts and the two totals.
3. Gains join the postings of their bucket group, where each chunk adds up count * gain by document, and
   documents add up what the groups give.

The draw adds Gumbel noise from a hash of ``seed`` and doc_id, so it repeats, and takes the highest scores: a sort by ranges numbers them.

Defined results: rows of one doc_id are one document (its counts add up), those of a null doc_id too, whose noise is that of the empty
id; null and empty texts have no features and weight 0; ties go to the smaller doc_id, null first; an empty table gives no rows, an empty
target leaves t and T at 0; extra columns, whatever their names, are not read; texts of any length are read whole, a slice of
texts at a time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, stored, table, text_slices, with_clear_names
from .words import LOWER

BUCKETS, RUNS, SEED, SHARE, LEAST_WORDS = 10_000, 1, 2024, 10, 20
#: Neighbouring buckets of a group; least places a group's chunks are dealt over; postings that a task holds before it sends them, and of a chunk.
GROUP, SALTS, HELD, CHUNK = 100, 4, 1 << 21, 1 << 16
#: Bytes that belong to words: letters and digits of ASCII and all of other characters.
WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: Words up to this size are hashed side by side.
SIDE = 48
#: docs are differences to base, in 4 or 8 bytes.
POSTINGS = "bucket_group int, salt int, base long, buckets binary, docs binary, nulls binary, counts binary, totals array<long>"


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


CRC = _crc_table()


def crc32_all(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each byte range; ranges of up to SIDE bytes side by side, byte by byte."""
    out = np.zeros(len(first), np.uint32)
    order = np.argsort(np.minimum(size, SIDE + 1).astype(np.uint8), kind="stable")
    sizes, at = size[order], first[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    short = int(np.searchsorted(sizes > SIDE, True))
    for j in range(int(sizes[short - 1]) if short else 0):
        go = slice(int(np.searchsorted(sizes[:short], j, "right")), short)
        crc[go] = CRC[(crc[go] ^ data[at[go] + j]) & 0xFF] ^ (crc[go] >> np.uint32(8))
    out[order] = ~crc
    for i in order[short:].tolist():
        out[i] = zlib.crc32(data[first[i] : first[i] + size[i]])
    return out


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each feature of texts whose bytes lie one after another, and the number of words of each text."""
    low = LOWER[data]
    word = WORD[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate(([False], word)), np.concatenate((word, [False]))
    first = np.flatnonzero(after & (~before | edge))
    last = np.flatnonzero(before & (~after | edge))
    begin = np.searchsorted(first, offsets)
    counts = np.diff(begin)
    text = np.repeat(np.arange(len(offsets) - 1), counts)
    if runs > 1:  # words joined by one space, so that a run is a byte range
        size = last - first
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        place = np.cumsum(size + 1) - size - 1
        source = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        joined[np.repeat(place - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = low[source]
        low, first, last = joined, place, place + size
    owners, found = [], []
    for k in range(runs):
        n = max(0, len(first) - k)
        own = np.flatnonzero(text[:n] == text[k:]) if k else np.arange(n)
        found.append(crc32_all(low, first[own], last[own + k] - first[own]) % np.uint32(buckets))
        owners.append(text[own])
    return np.concatenate(owners), np.concatenate(found).astype(np.int64), counts


def _packed(ids: np.ndarray) -> tuple[int, bytes]:
    base = int(ids.min())
    wide = int(ids.max()) - base >= 1 << 32
    return (0, ids.tobytes()) if wide else (base, (ids - base).astype(np.uint32).tobytes())


def _unpacked(base: int, docs: bytes, n: int) -> np.ndarray:
    return np.frombuffer(docs, np.int64) if len(docs) == 8 * n else np.frombuffer(docs, np.uint32).astype(np.int64) + base


def _chunks(texts: list[np.ndarray], ids: np.ndarray, nulls: np.ndarray, keys: list[np.ndarray], sizes: list[np.ndarray], buckets: int, runs: int):
    """Rows of POSTINGS without salt: chunks of each bucket group, and one of group -1 with each document's number of features and words."""
    owner, bucket = np.concatenate(texts), np.concatenate(keys)
    key = np.sort((bucket << 32) | owner)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key))).astype(np.int32)
    bucket, owner = key[at] >> 32, key[at] & 0xFFFFFFFF
    edges = np.searchsorted(bucket, np.arange(0, buckets + GROUP, GROUP)).tolist()
    for g, (begin, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        for a in range(begin, end, CHUNK):
            own = slice(a, min(a + CHUNK, end))
            local = bucket[own] - g * GROUP
            totals = np.bincount(local, weights=count[own], minlength=GROUP).astype(np.int64)
            yield g, *_packed(ids[owner[own]]), local.astype(np.uint16).tobytes(), np.packbits(nulls[owner[own]]).tobytes(), count[own].tobytes(), totals.tolist()
    words = np.concatenate(sizes)
    number = words.astype(np.int64)
    for k in range(1, runs):
        number = number + np.maximum(words - k, 0)
    yield -1, *_packed(ids), words.astype(np.int64).tobytes(), np.packbits(nulls).tobytes(), number.tobytes(), [int(number.sum())]


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """Rows of POSTINGS over all texts.  A task holds at most HELD postings and a slice of texts."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_parse_datatype_string(POSTINGS))
    rows = with_clear_names(docs, key, text).select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string"))
    salts = max(SALTS, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * GROUP // buckets)

    def run(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId()
        texts, ids, nulls, keys, sizes, n, held = [], [], [], [], [], 0, 0

        def flush():
            nonlocal salt
            found = []
            for group, base, packed, places, missing, counts, totals in _chunks(texts, np.concatenate(ids), np.concatenate(nulls), keys, sizes, buckets, runs):
                found.append((group, salt % salts, base, places, packed, missing, counts, totals))
                salt += 1
            columns = list(zip(*found, strict=True))
            for x in (texts, ids, nulls, keys, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for part, data, offsets in text_slices(batch, 1):
                owner, bucket, words = features(data, offsets, buckets, runs)
                column = part.column(0)
                texts.append(owner + n), keys.append(bucket), sizes.append(words)
                ids.append(column.fill_null(0).to_numpy(zero_copy_only=False)), nulls.append(column.is_null().to_numpy(zero_copy_only=False))
                n, held = n + len(words), held + len(owner)
                if held >= HELD:
                    yield flush()
                    n = held = 0
        if ids:
            yield flush()

    return rows.mapInArrow(run, POSTINGS)


def _by_bucket(chunks: DataFrame, name: str) -> DataFrame:
    """(bucket_group, place, count): the corpus' features in each bucket that has some."""
    return (
        chunks.where("bucket_group >= 0")
        .select("bucket_group", F.posexplode("totals").alias("place", "n"))
        .where("n > 0")
        .groupBy("bucket_group", "place")
        .agg(F.sum("n").alias(name))
    )


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket_group, gains array<long>) from both corpora's postings: counts meet by bucket, so at most ``buckets`` numbers in all."""
    totals = documents.where("bucket_group < 0").agg(F.coalesce(F.sum(F.col("totals")[0]), F.lit(0)).alias("all_s"))
    totals = totals.crossJoin(target.where("bucket_group < 0").agg(F.coalesce(F.sum(F.col("totals")[0]), F.lit(0)).alias("all_t")))
    both = _by_bucket(documents, "s").join(_by_bucket(target, "t"), ["bucket_group", "place"], "left").fillna(0, ["t"])
    real = lambda c, k: (F.col(c) + F.lit(k)).cast("double")
    ratio = (real("t", 1) * real("all_s", buckets)) / (real("s", 1) * real("all_t", buckets))
    gain = F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")
    return (
        both.crossJoin(F.broadcast(totals))
        .select("bucket_group", "place", gain.alias("gain"))
        .groupBy("bucket_group")
        .agg(F.map_from_entries(F.collect_list(F.struct("place", "gain"))).alias("by_place"))
        .select("bucket_group", F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda p: F.coalesce(F.col("by_place")[p], F.lit(0))).alias("gains"))
    )


def contributions(index: DataFrame, by_group: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight): what each chunk of the index gives each of its documents."""

    def run(batch: pa.RecordBatch):
        for group, base, buckets, docs, nulls, counts, gain in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            ids = _unpacked(base, docs, len(buckets) // (8 if group < 0 else 2))
            missing = np.unpackbits(np.frombuffer(nulls, np.uint8), count=len(ids)).astype(bool)
            if group < 0:
                zero = np.zeros(len(ids), np.int64)
                yield [pa.array(ids, mask=missing), np.frombuffer(buckets, np.int64), np.frombuffer(counts, np.int64), zero]
                continue
            value = np.frombuffer(counts, np.int32) * np.array(gain, np.int64)[np.frombuffer(buckets, np.uint16)]
            order = np.lexsort((ids, missing))
            ids, missing, value = ids[order], missing[order], value[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (missing[1:] != missing[:-1])
            at = np.flatnonzero(new)
            zero = np.zeros(len(at), np.int64)
            yield [pa.array(ids[at], mask=missing[at]), zero, zero, np.add.reduceat(value, at)]

    joined = index.join(F.broadcast(by_group), "bucket_group", "left")  # at most ``buckets`` numbers
    return arrow_map(joined.select("bucket_group", "base", "buckets", "docs", "nulls", "counts", "gains"), run, "doc_id long, n_words long, n_features long, weight long")


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, runs: int = RUNS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: the sum of its features' gains."""
    index = stored(postings(docs, key, text, buckets, runs).repartition("bucket_group", "salt"), "postings")
    own = postings(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_text}`").alias("text")), "doc_id", "text", buckets, runs)
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    return contributions(index, stored(gains(index, own, buckets), "gains")).groupBy("doc_id").agg(*sums)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each document; ``share`` percent of those with ``least_words`` words or more are drawn."""
    spark = docs.sparkSession
    unit = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(unit))).cast("long")
    scored = stored(weights(docs, target, **options).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * share // 100
    # scores above the one that the draw ends in, in ranges: their places come from counts of the ranges before them
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    ranged = able.select("doc_id", "score").repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.select("doc_id", "score", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "ranged")
    before, bases = 0, []
    for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).orderBy("part").collect():
        bases.append((r["part"], before - r["least"] + 1))
        before += r["rows"]
    base = spark.createDataFrame(bases, "part int, base long")  # a row for each range
    placed = ranged.join(F.broadcast(base), "part").select("doc_id", (F.col("n") + F.col("base")).alias("rank")).where(F.col("rank") <= drawn)
    placed = placed.select(F.col("doc_id").alias("drawn_id"), "rank")
    return scored.join(placed, F.col("doc_id").eqNullSafe(F.col("drawn_id")), "left").select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 in DuckDB SQL: its table of 256 numbers, and the crc of a text in the column ``w`` of a row that has the table as ``t``.
CRC_TABLE_SQL = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))"
CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))), "
    "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
)
_WORDS_SQL = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w"
ORACLE_SQL = f"""
WITH crc AS ({CRC_TABLE_SQL}),
d AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, {_WORDS_SQL} FROM documents) GROUP BY ALL),
b AS (SELECT w, count(*) AS n FROM (SELECT {_WORDS_SQL} FROM benchmark) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT w, {CRC_SQL} % {BUCKETS} AS bucket FROM (SELECT DISTINCT w FROM (SELECT w FROM d UNION SELECT w FROM b)), crc),
s AS (SELECT bucket, sum(n) AS s FROM d JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM b JOIN hashed USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000.0 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM d) + {BUCKETS} AS DOUBLE))
    / (CAST(s + 1 AS DOUBLE) * CAST((SELECT coalesce(sum(n), 0) FROM b) + {BUCKETS} AS DOUBLE)))) AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM d JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN w USING (doc_id)),
able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, rank FROM scored
LEFT JOIN (SELECT * FROM able WHERE rank <= (SELECT count(*) * {SHARE} // 100 FROM able)) USING (doc_id)
"""


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
