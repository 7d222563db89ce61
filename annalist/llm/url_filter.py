"""Operator 10, URL filter: host and path rules, then logistic regression on hashed character n-grams.

The rules come first (the longest that fits decides).  Where none fits, a logistic regression over
hashed n-grams of host and path decides; it is fitted on the small labelled table of ``url_table``, whose size
is fixed, so the weights (BUCKETS doubles) are all that goes to the executors.  The cut comes from scores of whole families of that
table that a fit has not seen (``unseen_scores``).

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by the model on empty text (its intercept).  Repeated rows get equal verdicts, rows of a null page_id their own; an empty table
gives no rows; urls of any length are judged whole; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, with_clear_names
from .url_table import families

BUCKETS, SIZES, EPOCHS, RATE, DECAY, CUT = 1 << 17, (3, 4, 5), 300, 4.0, 1e-4, 0.46
#: The share of rows of label 0 in unseen families that the cut may block; families are dealt into so many folds.
FALSE_BLOCKS, FOLDS = 0.05, 5
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def training_table() -> list[tuple[str, int]]:
    return [(url, label) for _, url, label in families()]


def unseen_scores() -> tuple[np.ndarray, np.ndarray]:
    """(score, label) of each row of the table, by a model fitted on the families of the other folds."""
    rows = families()
    fold = np.array([zlib.crc32(family.encode()) % FOLDS for family, _, _ in rows])
    out = np.zeros(len(rows))
    for k in range(FOLDS):
        weights, intercept = fit([(u, label) for (_, u, label), f in zip(rows, fold, strict=True) if f != k])
        parts = [split_url(u) for (_, u, _), f in zip(rows, fold, strict=True) if f == k]
        out[fold == k] = scores(weights, intercept, [h for h, _ in parts], [p for _, p in parts])
    return out, np.array([label for _, _, label in rows])


def choose_cut(found: np.ndarray, labels: np.ndarray, false_blocks: float = FALSE_BLOCKS) -> float:
    """The least cut in hundredths that blocks at most the given share of rows of label 0."""
    return next(c / 100 for c in range(1, 101) if np.mean(found[labels == 0] >= c / 100) <= false_blocks)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+([^?#]*)", 1), F.lit(""))


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule(host_column: Column, path_column: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        site, slash, rest = name.partition("/")
        fits = ((host_column == site) | host_column.endswith("." + site)) & path_column.startswith(slash + rest)
        text, verdict = F.when(fits, name).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of ``^host$`` and ``^path$``; n-grams of host and path hash apart."""
    rows, buckets = [], []
    for part, texts in enumerate((hosts, paths)):
        coded = [b"^" + t.encode() + b"$" for t in texts]
        data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
        text = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
        for n in SIZES:
            if len(data) < n:
                continue
            with np.errstate(over="ignore"):
                h = np.full(len(data) - n + 1, np.uint64(1469598103934665603 + 1000003 * n + part))
                for j in range(n):
                    h = (h ^ data[j : len(data) - n + 1 + j]) * np.uint64(1099511628211)
                h ^= h >> np.uint64(29)
            same = text[: len(h)] == text[n - 1 :]
            rows.append(text[: len(h)][same])
            buckets.append((h[same] % np.uint64(BUCKETS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def scores(weights: np.ndarray, intercept: float, hosts: list[str], paths: list[str]) -> np.ndarray:
    rows, buckets = grams(hosts, paths)
    count = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
    return 1 / (1 + np.exp(-(np.bincount(rows, weights[buckets], len(hosts)) / np.sqrt(count) + intercept)))


def fit(labelled: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    parts = [split_url(u) for u, _ in labelled]
    y = np.array([label for _, label in labelled], float)
    rows, buckets = grams([h for h, _ in parts], [p for _, p in parts])
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(EPOCHS):
        miss = 1 / (1 + np.exp(-(np.bincount(rows, w[buckets], len(y)) * scale + b))) - y
        w -= RATE * (np.bincount(buckets, (miss * scale)[rows], BUCKETS) / len(y) * 10 + DECAY * w)
        b -= RATE * miss.mean() / 10
    return w, b


@lru_cache(maxsize=1)
def default_model() -> tuple[np.ndarray, float]:
    """The model of the whole table, fitted once in a process."""
    return fit(training_table())


def filter_urls(pages: DataFrame, rules=RULES, labelled=None, key: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row.  No shuffle."""
    weights, intercept = fit(labelled) if labelled else default_model()
    u = F.col(f"`{url}`").cast("string")
    split = with_clear_names(pages, key, url).select(F.col(f"`{key}`").cast("long").alias("page_id"), host(u).alias("host"), path(u).alias("path"))

    def run(batch: pa.RecordBatch):
        yield [batch.column(0), batch.column(1), batch.column(2), scores(weights, intercept, batch.column(1).to_pylist(), batch.column(2).to_pylist())]

    scored = arrow_map(split, run, "page_id long, host string, path string, score double")
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("score") >= CUT, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
