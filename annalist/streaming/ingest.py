"""Incremental ingestion: commits come as a stream, knowledge tables are merged by key.

Extraction is stateless.  Each micro-batch is one change of keyed tables (see ``tables``), so readers see all of it or nothing, and a batch that
runs again changes nothing.  Commits come from exported logs, or from a repository (``sources.commit_source``), whose offsets are the cursor.
Contributors can also be kept as streaming state: one row per contributor, which bounds it without a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, ownership
from ..sources import files
from ..storage import cut
from . import ownership as live
from .tables import Change, Tables


def commit_stream(spark: SparkSession, folder: str, repository_id: str) -> DataFrame:
    """New files of NUL-ended commit records below a folder."""
    return files.parse_commits(spark.readStream.text(folder, lineSep="\0"), repository_id)


def running_contributors(commits: DataFrame) -> DataFrame:
    """Counts and first and last time of each author, for update or complete mode."""
    own = ownership.with_contributor(commits).where("contributor_id IS NOT NULL")
    return own.groupBy("contributor_id").agg(F.count(F.lit(1)).alias("commit_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def take(change: Change, rows: DataFrame, gone: DataFrame | None = None) -> None:
    """Puts sources and what they say into a change's tables, takes those of gone(id) out, and brings contributors and expertise up to date."""
    rows = cut(rows.groupBy("id").agg(F.max(F.struct(*[c for c in rows.columns if c != "id"])).alias("r")).select("id", "r.*").select(*rows.columns))
    ids = rows.select("id") if gone is None else rows.select("id").unionByName(gone.select("id"))
    change.merge("sources", rows, gone=gone)
    for name, made in (("events", extract.events(rows)), ("intents", extract.intents(rows)), ("facts", extract.facts(rows)), ("decisions", extract.decisions(rows))):
        # what an earlier version of a source said goes with it
        old = change.read(name)
        said = old.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("id").join(made.select("id"), "id", "left_anti") if old is not None else None
        change.merge(name, made, gone=said)
    live.apply(change, rows, gone)


def ingest(stream: DataFrame, tables: Tables, checkpoint: str):
    """Runs all new rows through extraction and into the tables, then stops.  The tables remember the last batch of each checkpoint, so a batch that
    runs again after a crash is taken once."""

    def batch(rows: DataFrame, number: int) -> None:
        change = tables.change(checkpoint, number)
        if change is not None:
            take(change, rows)
            change.commit()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keys_seen(tables: Tables) -> DataFrame:
    """The cursor: ids that a later scan can skip."""
    found = tables.read("sources")
    return found.select("id") if found is not None else tables.spark.createDataFrame([], "id string")


__all__ = ["Tables", "commit_stream", "ingest", "keys_seen", "running_contributors", "take"]
