"""Operator 9, quality rules: base rules over words and lines, then compression bands.

Compression bands.  A text's ratio is its zstandard size over its size in bytes.  Repetitive text
compresses far below what prose of its length does; noise (keys, encoded data, tables of random
cells) hardly compresses at all.  The ratio of any text falls with its length, so the limits are functions of length
without steps: lines through bands that are fitted on clean documents with margins (``fit_bands``).  The whole text is
measured, and every fixed chunk of each of the sizes in CHUNKS that the text is long enough for; where the last is not full, one
more ends at the text's end.  So a bad passage can't hide behind good ones: a text is rejected when its whole ratio leaves the
limits, or when chunks that leave theirs cover more than a share of it.  That share falls from all of a text of half a size's
length to BAD_CHUNKS at the full length, so no size begins at once.

Defined results: null and empty texts have no words, so the base rules reject them, and a ratio of 1.  Texts of any length have a
band; very long ones are measured whole and by chunks.  Repeated rows get equal results, rows of a null doc_id their own; an empty table
gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_slices, with_clear_names
from .words import SPACE, Words, repeated, sums

WINDOW, FEWEST_WORDS, REPEAT_PERCENT = 8, 20, 30
LEVEL, BAD_CHUNKS = 3, 0.1
#: Lengths at which a band begins.
STEPS = (256, 384, 448, 512, 640, 768, 896, 1024, 1280, 1536, 1792, 2048, 2560, 3072, 3584, 4096, 5120, 6144, 7168, 8192, 10240)
#: (bytes, lowest ratio) of longer texts, where clean documents are few: clean documents of one language joined, 12 to 48 of each length, have at
#: least 0.409, 0.379, 0.366, 0.356 and, at 1 MB, 0.343; the margin is 0.06.  Longer ones keep the last.
LONG_LOWS = ((16384, 0.349), (32768, 0.319), (65536, 0.306), (131072, 0.296), (1048576, 0.283))
#: (bytes from which they hold, margin below the lowest, above the highest ratio of clean documents).  Short texts of rich words
#: (licenses) lie up to 0.08 above the clean documents; long prose of few words lies up to 0.06 below them.
MARGINS = ((256, 0.01, 0.08), (2048, 0.01, 0.03), (8192, 0.06, 0.03))
#: The same for shorter texts, where clean documents are few: the range of those 119 and of 4,784 to 4,952 pieces of each length cut
#: from longer ones (0.737 to 1.141, 0.697 to 1.09, 0.628 to 0.953, 0.588 to 0.89, 0.601 to 0.846, 0.598 to 0.82 from 64 bytes on), with
#: margins of 0.023 to 0.037 and 0.06 to 0.07.  Below 64 bytes the frame's fixed cost leaves room for a lower limit alone.
SHORT_BANDS = ((0, 0.7, 9.0), (64, 0.7, 1.2), (96, 0.66, 1.15), (128, 0.605, 1.02), (160, 0.565, 0.95), (192, 0.575, 0.91), (224, 0.575, 0.88))
#: (bytes from which the band holds, lowest and highest ratio of a kept text): the short ones, then fit_bands on the documents of sf0.1 that pass
#: the base rules, have label 1 and aren't held out.
BANDS = (*SHORT_BANDS, (256, 0.589, 0.82), (384, 0.532, 0.778), (448, 0.532, 0.76), (512, 0.532, 0.76), (640, 0.515, 0.757), (768, 0.505, 0.701), (896, 0.496, 0.664), (1024, 0.484, 0.659), (1280, 0.479, 0.639), (1536, 0.47, 0.622), (1792, 0.455, 0.606), (2048, 0.455, 0.551), (2560, 0.454, 0.538), (3072, 0.447, 0.518), (3584, 0.442, 0.513), (4096, 0.429, 0.502), (5120, 0.426, 0.495), (6144, 0.421, 0.488), (7168, 0.417, 0.482), (8192, 0.367, 0.479), (10240, 0.35, 0.474), (16384, 0.349, 0.474), (32768, 0.319, 0.474), (65536, 0.306, 0.474), (131072, 0.296, 0.474), (1048576, 0.283, 0.474))
#: (bytes from which bad chunks may cover BAD_CHUNKS of a text, their size, lowest and highest ratio of a chunk, which is compressed alone).  In
#: the same clean documents chunks of these sizes have 0.563 to 0.82, 0.518 to 0.715, 0.496 to 0.602 and 0.448 to 0.482; margins 0.07
#: and 0.06, 0.06 and 0.08, from 1,024 bytes on 0.06 and 0.08 or 0.03.
CHUNKS = ((512, 256, 0.493, 0.88), (1024, 512, 0.458, 0.795), (8192, 1024, 0.436, 0.682), (32768, 4096, 0.388, 0.512))
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, worst_low double, worst_high double, bad_chunk_share double"


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols and n_repeat_words of each text."""
    words = Words(data, offsets)
    starts = (data & 0xC0) != 0x80
    at, windows = words.windows(WINDOW)
    with np.errstate(over="ignore"):
        twice = repeated(windows ^ ((words.text[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)))
    cover = np.zeros(len(words.first) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    return {
        "n_words": words.count,
        "word_chars": sums(starts & ~SPACE[data], offsets),
        "n_symbols": sums(SYMBOL[data], offsets),
        "n_repeat_words": sums(np.cumsum(cover)[:-1] > 0, words.begin),
    }


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _lines(bands: tuple[tuple[int, float, float], ...]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(binary logarithm of a length, limit) of the lowest and the highest ratio at the middle of each band, of the lowest at its begin from where
    the margin is widest; neither limit rises with length."""
    begin = np.log2([max(at, 1) for at, _, _ in bands])
    middle = np.append((begin[:-1] + begin[1:]) / 2, begin[-1])
    _, lows, highs = zip(*bands, strict=True)
    return (np.where(begin < math.log2(MARGINS[-1][0]), middle, begin), np.minimum.accumulate(lows)), (middle, np.maximum.accumulate(highs[::-1])[::-1])


LINES = _lines(BANDS)


def band(size: int) -> tuple[float, float]:
    """The lowest and highest ratio of a kept text."""
    at = math.log2(max(size, 1))
    return tuple(float(np.interp(at, x, limits)) for x, limits in LINES)


def bad_share(size: int, full: int) -> float:
    """The share of a text that bad chunks of a size may cover: all below half its full length, BAD_CHUNKS from there on."""
    return min(1.0, max(BAD_CHUNKS, BAD_CHUNKS + (1 - BAD_CHUNKS) * math.log2(full / size)))


def fit_bands(sizes: np.ndarray, found: np.ndarray) -> tuple[tuple[int, float, float], ...]:
    """Bands from the sizes and ratios of clean documents: their range in each step and the margins, falling with length."""
    step = np.searchsorted(STEPS, sizes, "right") - 1
    ranges = [(found[step == k].min(), found[step == k].max()) for k in range(len(STEPS))]
    below, above = np.array(MARGINS)[np.searchsorted([at for at, _, _ in MARGINS], STEPS, "right") - 1, 1:].T
    lows = np.minimum.accumulate([a for a, _ in ranges]) - below
    highs = np.maximum.accumulate([b for _, b in ranges][::-1])[::-1] + above
    bands = [(at, round(float(a), 3), round(float(b), 3)) for at, a, b in zip(STEPS, lows, highs, strict=True)]
    return (*bands, *((at, low, bands[-1][2]) for at, low in LONG_LOWS))


def ratios(text: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float, float, float, bool]:
    """Ratio of the whole, lowest and highest of it and all chunks, largest share that bad chunks of a size cover, and the verdict."""
    if not text:
        return 1.0, 1.0, 1.0, 0.0, True
    whole = len(compressor.compress(text)) / len(text)
    low, high = band(len(text))
    kept, lowest, highest, worst = low <= whole <= high, whole, whole, 0.0
    for full, size, low, high in CHUNKS:
        allowed = bad_share(len(text), full)
        if allowed >= 1 or size > len(text):
            continue
        starts = [*range(0, len(text) - size + 1, size), *([len(text) - size] if len(text) % size else [])]
        found = [len(compressor.compress(text[i : i + size])) / size for i in starts]
        own = [size] * (len(text) // size) + [len(text) % size] * (len(text) % size > 0)  # bytes that no chunk before covers
        bad = sum(n for x, n in zip(found, own, strict=True) if not low <= x <= high) / len(text)
        kept, lowest, highest, worst = kept and bad <= allowed, min(lowest, *found), max(highest, *found), max(worst, bad)
    return whole, lowest, highest, worst, kept


def _judge(batch: pa.RecordBatch):
    compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    for rows, data, offsets in text_slices(batch, 1):
        base = base_counts(data, offsets)
        whole = data.tobytes()
        texts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        found = [ratios(x, compressor) for x in texts]
        failed = (base["n_words"] < FEWEST_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
        whole_ratio, low, high, bad, good = zip(*found, strict=True)
        yield [rows.column(0), base["n_words"], base["word_chars"], base["n_symbols"], [repeated_lines(x) for x in texts], base["n_repeat_words"], failed, ~failed & np.array(good), whole_ratio, low, high, bad]


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: counts, ratios and the verdict.  No shuffle."""
    rows = with_clear_names(docs, key, text)
    return arrow_map(rows.select(F.col(rows.columns[0]).cast("long"), F.col(rows.columns[1]).cast("string")), _judge, SCHEMA)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return quality_rules(table(spark, sf_dir, "documents"))
