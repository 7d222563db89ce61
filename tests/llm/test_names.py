"""Extra columns named like the operators' own change nothing; statistics and fit of the classifier against plain versions."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import bpe, common, media, near_duplicates, packing, quality_classifier, quality_rules, simple8b, url_filter, warc, wordpiece
from tests.llm.test_quality import WORDS, brute

#: Names that the operators use for columns of their own.
NAMES = "ids offset df digest shard refers_to key n text_ tokens part base counts band hub kept score n_words value group start length sequence_id payload host path measured total".split()


@pytest.fixture(scope="module")
def clash(docs):
    return docs.select("doc_id", "text", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


OPERATORS = {
    "bpe": bpe.encoding_digests,
    "wordpiece": wordpiece.token_counts,
    "statistics": quality_classifier.text_statistics,
    "rules": quality_rules.quality_rules,
    "near": near_duplicates.near_duplicates,
    "ids": lambda d: simple8b.read_ids(simple8b.write_ids(d, common.shared_folder(d.sparkSession, "ids")), digest=True),
    "packing": lambda d: packing.pack(d, digest=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(docs, clash, name):
    run = OPERATORS[name]
    assert rows(run(clash.coalesce(1))) == rows(run(docs.select("doc_id", "text").coalesce(1)))


def test_clashing_names_of_pages_and_media(spark, docs, clash):
    def features(d):
        index = media.write_shards(d, common.shared_folder(spark, "media"))
        return rows(index.select("doc_id", "n_bytes", "digest")), rows(media.media_features(index).select("digest", "payload_sha256", "media_sha256", "feature"))

    assert features(clash) == features(docs)
    pages = spark.createDataFrame([(1, "http://a.org/x", "<p>"), (2, None, None), (3, "http://b.net/", "<p>")], "page_id long, url string, html string")
    more = pages.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])
    assert rows(url_filter.filter_urls(more)) == rows(url_filter.filter_urls(pages))
    read = lambda p: warc.read_archives(warc.write_archives(warc.plan_records(p), common.shared_folder(spark, "warc")))
    keep = lambda df: rows(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    assert keep(read(more)) == keep(read(pages))


def plain_statistics(text):
    """Each statistic by its definition, word by word."""
    words = [w.encode() for w in WORDS.findall(text or "")]
    raw = (text or "").encode()
    n, size = max(len(words), 1), max(sum(len(w.decode()) for w in words), 1)
    letters = sum(chr(b).isalpha() and b < 128 for b in raw)
    windows = [tuple(words[i : i + quality_classifier.WINDOW]) for i in range(len(words) - quality_classifier.WINDOW + 1)]
    many = Counter(windows)
    return {
        "log_words": math.log1p(len(words)), "word_length": sum(len(w.decode()) for w in words) / n, "upper": sum(65 <= b <= 90 for b in raw) / max(letters, 1), "digits": sum(48 <= b <= 57 for b in raw) / size,
        "distinct": len(set(words)) / n if words else 0, "windows": sum(many[w] > 1 for w in windows) / n, "lines": brute(text)[3] / ((text or "").count("\n") + 1), "line_words": len(words) / ((text or "").count("\n") + 1),
    }


def test_statistics_equal_definition(docs):
    """Half of the statistics of odd texts."""
    texts = [r.text for r in docs.collect()] + ["A1 B2\n\nA1 B2\nx", "É É é 7", "Same line\nSame line\nSame line"]
    spelled = [(t or "").encode() for t in texts]
    found = quality_classifier.statistics(np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)]))
    assert found.shape[1] == len(quality_classifier.STATISTICS)
    for text, row in zip(texts, found, strict=True):
        want = plain_statistics(text)
        for name in want:
            assert row[quality_classifier.STATISTICS.index(name)] == pytest.approx(want[name]), (name, text[:40] if text else text)


def test_fit_is_at_its_optimum():
    """Weights of rules on standardized columns: the loss' slope is the penalty where a weight is not 0, and no steeper where it is."""
    rng = np.random.default_rng(4)
    x = rng.random((400, len(quality_classifier.STATISTICS)))
    y = (x[:, 0] + 0.4 * x[:, 5] + 0.1 * rng.random(400) > 0.8).astype(int)
    model = quality_classifier.fit_rules(x, y)
    place = {n: i for i, n in enumerate(quality_classifier.STATISTICS)}
    holds = np.array([[all((r[place[n]] > b) if above else (r[place[n]] <= b) for n, above, b in parts) for _, parts in model.rules] for r in x], float)
    weights = np.array([w for w, _ in model.rules])
    z = (holds - holds.mean(0)) / holds.std(0)
    miss = 1 / (1 + np.exp(-(holds @ weights + model.intercept))) - y
    slope = z.T @ miss / len(y)
    assert abs(miss.mean()) < 1e-3
    assert np.abs(slope + np.sign(weights) * quality_classifier.PENALTY).max() < 0.1 * quality_classifier.PENALTY
