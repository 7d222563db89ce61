"""A corpus pipeline: quality classifier, quality rules, near duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), its result is written as
Parquet and read again as the next stage's docs.  All but the last keep the columns of ``documents``.

Defined results of every stage: an empty table gives no rows; texts of any length are read whole; extra columns, whatever their names,
pass through (the last stage does not read them); repeated rows are judged alike; a null in any other column changes nothing.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import named, shared_folder, stored, table, with_statistics
from annalist.llm.near_duplicates import near_duplicates
from annalist.llm.packing import pack
from annalist.llm.quality_classifier import STATISTICS, THRESHOLD, statistics, train
from annalist.llm.quality_rules import FEWEST_WORDS, LEVEL, REPEAT_PERCENT, base_counts, ratios


def classify_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold, by a classifier fitted on this stage's labelled documents.

    The rows themselves pass through, so no join is needed; null and empty texts are scored like any other; rows of a null doc_id are scored
    and never learnt from; without usable labels every row has one score, which keeps or drops all.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    scored, column = with_statistics(docs, "text", STATISTICS, statistics)
    return scored.where(model.score(f"{column}.") >= THRESHOLD).select(*named(docs))


def _verdicts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    base = base_counts(data, offsets)
    failed = (base["n_words"] < FEWEST_WORDS) | (100 * base["n_repeat_words"] > REPEAT_PERCENT * base["n_words"])
    compressor, whole = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False), data.tobytes()
    good = [ratios(whole[a:b], compressor)[4] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return (~failed & np.array(good, bool)).astype(float)[:, None]


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep; null and empty texts go, a null doc_id is no reason."""
    judged, column = with_statistics(docs, "text", ("kept",), _verdicts)
    return judged.where(F.col(f"{column}.kept") == 1).select(*named(docs))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group; rows of a null doc_id stay, all rows of a kept doc_id too, and texts without words."""
    dropped = near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(stored(dropped, "dropped"), "doc_id", "left_anti").select(*named(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, as op5 returns them; null and empty texts are their end id, a null doc_id is kept."""
    return pack(docs, digest=True)


STAGES = [("quality classifier", classify_stage), ("quality rules", rules_stage), ("near duplicates", duplicates_stage), ("packing", packing_stage)]
#: A fitted ensemble and BM25 packing have no SQL form; the tests hold run() against the operators' brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what the one before it kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = shared_folder(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
