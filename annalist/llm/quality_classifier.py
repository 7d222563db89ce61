"""Operator 3, quality classifier: a sparse ensemble of rules over text statistics.

1. ``text_statistics`` measures every whole text (vectorised, one pass, no shuffle).
2. ``fit_rules`` boosts shallow trees on labelled rows, takes every path from a root to a node as a
   conjunction of comparisons, and fits logistic weights with an L1 penalty, which leaves few rules.
3. ``RuleModel.score`` compiles those rules into one Spark column expression.

Only the statistics are inputs: never labels, lang, source or doc_id.  The fit takes at most
``max_rows`` labelled rows (documented bound, chosen by a hash of the key over all labels), so what
the driver holds does not grow with the corpus.  Scoring covers all rows.

Defined results: null and empty texts have all statistics 0 and are scored like any other row;
repeated rows get equal scores; a labelled doc_id of several texts is learnt once, from the least row of statistics, and one of
several labels once with each; rows of a null doc_id are scored and never learnt from; an empty table gives no rows; extra
columns, whatever their names, are not read; very long texts are measured whole; with no usable label (or labels of one kind) the score is the
constant share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, text_slices, with_clear_names
from .quality_rules import WINDOW, repeated_lines
from .words import SPACE, Words, repeated, sums

STATISTICS = ("log_words", "word_length", "upper", "digits", "symbols", "shouts", "bars", "stops", "commas", "distinct", "stutter", "windows", "lines", "line_words", "longest", "marked_words")
MAX_ROWS, TREES, DEPTH, BINS, SHRINK, PENALTY, STEPS = 20_000, 40, 3, 32, 0.2, 0.002, 400
THRESHOLD = 0.3
_is = lambda chars: np.isin(np.arange(256), list(chars))
UPPER, LETTER, DIGIT, MARK = _is(range(65, 91)), _is([*range(65, 91), *range(97, 123)]), _is(range(48, 58)), _is(b"#*$%&|<>@^~_=+{}[]\\/")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    w = Words(data, offsets)
    n = np.maximum(w.count, 1)
    by_text = lambda flags: sums(flags, w.begin) / n
    bytes_of = lambda kind: sums(kind[data], offsets)
    chars = sums(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
    h = w.hashes()
    with np.errstate(over="ignore"):
        salt = (w.text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
        order = np.argsort(h ^ salt)
        at, windows = w.windows(WINDOW, h)
        twice = repeated(windows ^ salt[at])
    s = (h ^ salt)[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    distinct = np.bincount(w.text[order][new], minlength=len(n))[: len(n)]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    length = w.last - w.first
    marks = np.concatenate(([0], np.cumsum(MARK[data], dtype=np.int64)))
    end = data[np.maximum(w.last - 1, 0)] if len(data) else np.zeros(0, np.uint8)
    whole = data.tobytes()
    longest = np.zeros(len(n))
    np.maximum.at(longest, w.text, length)
    again = np.array([repeated_lines(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], float)
    lines = sums(data == 10, offsets) + 1
    size = np.maximum(chars, 1)
    covered = np.bincount(w.text[at[twice]], minlength=len(n))[: len(n)]
    return np.column_stack([
        np.log1p(w.count), chars / n, bytes_of(UPPER) / np.maximum(bytes_of(LETTER), 1), bytes_of(DIGIT) / size, bytes_of(MARK) / size,
        sums(data == 33, offsets) / n, by_text((length == 1) & (data[np.minimum(w.first, len(data) - 1)] == 124) if len(data) else np.zeros(0)), by_text(np.isin(end, list(b".?!"))), by_text(end == 44),
        distinct / n, by_text(same), covered / n, again / lines, w.count / lines, longest, by_text(marks[w.last] > marks[w.first]),
    ]).astype(np.float64)


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, STATISTICS...) for each row."""

    def run(batch: pa.RecordBatch):
        for rows, data, offsets in text_slices(batch, 1):
            found = statistics(data, offsets)
            yield [rows.column(0), *found.T]

    return arrow_map(with_clear_names(docs, key, text).select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string")), run, "doc_id long, " + ", ".join(f"{x} double" for x in STATISTICS))


@dataclass(frozen=True)
class RuleModel:
    """Each rule: (weight, ((statistic, is_above, bound), ...))."""

    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self, prefix: str = "") -> Column:
        """The probability of label 1 as a Spark expression over the statistics (below a struct column, by prefix)."""
        total = F.lit(self.intercept)
        for weight, parts in self.rules:
            holds = F.lit(True)
            for name, above, bound in parts:
                holds = holds & ((F.col(prefix + name) > bound) if above else (F.col(prefix + name) <= bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int) -> list[tuple[tuple, np.ndarray]]:
    """Grows one tree; the paths to its nodes with the rows that follow them (leaves last)."""
    out: list[tuple[tuple, np.ndarray, bool]] = []

    def grow(rows: np.ndarray, path: tuple, left: int) -> None:
        best = (1e-9, None)
        if left and len(rows) >= 20:
            g, h = target[rows], weight[rows]
            base = g.sum() ** 2 / (h.sum() + 1.0)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, f], g, len(cuts[f]) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, f], h, len(cuts[f]) + 1))[:-1]
                gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - base
                gain[(hs < 0.5) | (h.sum() - hs < 0.5)] = 0
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if path:
            out.append((path, rows, best[1] is None))
        if best[1] is not None:
            f, k = best[1]
            low = binned[rows, f] <= k
            grow(rows[low], (*path, (f, False, float(cuts[f][k]))), left - 1)
            grow(rows[~low], (*path, (f, True, float(cuts[f][k]))), left - 1)

    grow(np.arange(len(x)), (), depth)
    return out


def _tidy(path: tuple) -> tuple:
    """The tightest bound for each statistic and direction."""
    bounds: dict[tuple[int, bool], float] = {}
    for f, above, bound in path:
        have = bounds.get((f, above))
        bounds[f, above] = bound if have is None else (max if above else min)(bound, have)
    return tuple(sorted((f, above, bound) for (f, above), bound in bounds.items()))


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Boosted trees, their paths as rules, then logistic weights with an L1 penalty (proximal gradient with momentum)."""
    y = y.astype(float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.02, 0.98)) if len(y) else 0.5
        return RuleModel(float(np.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    binned = np.column_stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)])
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        for path, rows, leaf in _paths(x, cuts, binned, y - p, p * (1 - p), DEPTH):
            rules.setdefault(_tidy(path))
            if leaf:
                margin[rows] += SHRINK * (y - p)[rows].sum() / ((p * (1 - p))[rows].sum() + 1.0)
    names = list(rules)
    holds = np.ones((len(y), len(names)), np.float32)
    for j, parts in enumerate(names):
        for f, above, bound in parts:
            holds[:, j] *= (x[:, f] > bound) if above else (x[:, f] <= bound)
    spread = holds.std(0)
    keep = spread > 0.005
    names, holds, spread = [r for r, k in zip(names, keep, strict=True) if k], holds[:, keep], spread[keep]
    z = (holds - holds.mean(0)) / spread
    rate = 4.0 / (np.linalg.norm(z.astype(np.float64).T @ z, 2) / len(y) + 1)
    w, b, old, t = np.zeros(z.shape[1]), np.log(y.mean() / (1 - y.mean())), np.zeros(z.shape[1]), 1.0
    for _ in range(STEPS):
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w + (t - 1) / u * (w - old)
        miss = 1 / (1 + np.exp(-(z @ v + b))) - y
        old, t = w, u
        w = v - rate * (z.T @ miss) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        b -= rate * miss.mean()
    raw = w / spread
    kept = np.flatnonzero(np.abs(raw) > 1e-6)
    intercept = float(b - (raw * holds.mean(0)).sum())
    return RuleModel(intercept, tuple((float(raw[j]), tuple((STATISTICS[f], a, c) for f, a, c in names[j])) for j in kept))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    """Fits on labelled rows that are not held out: at most max_rows of them, the first by a hash of the key."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    # max_rows bounds the broadcast side at 12 bytes a row
    rows = text_statistics(with_clear_names(docs, "doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("least")).select("doc_id", "least.*")
    rows = rows.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "quality").toPandas()
    return fit_rules(rows[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), rows["quality"].to_numpy())


def classify(docs: DataFrame, model: RuleModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    scored = text_statistics(docs).select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
