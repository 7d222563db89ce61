"""Registered queries over tables that were brought up to date batch by batch; their SQL computes the same from the whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import QUERIES, _bm25_sql, _docs
from .operators import search
from .plans.knowledge import Knowledge
from .plans.oracle import sql
from .sources.adapters import REPO
from .storage import with_checkpoints
from .streaming import ownership, search_index
from .streaming.tables import Tables


def _tables(k: Knowledge, name: str) -> Tables:
    """New tables in the shared folder."""
    with_checkpoints(k.spark)
    return Tables(k.spark, f"{k.spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")


def _owned(k: Knowledge) -> Tables:
    """Commits with every record under one author's name, then the records again as they are: the first author's counts are taken back."""
    tables = _tables(k, "ownership")
    one = k.records.withColumn("author", F.lit("User 0 <u0@example.com>")).withColumn("title", F.concat("title", F.lit(" storage agent")))
    for rows in (k.commits.unionByName(one), k.records):
        change = tables.change()
        ownership.apply(change, rows)
        change.commit()
    return tables


def live_contributors(k: Knowledge) -> DataFrame:
    return ownership.contributors(_owned(k).snapshot()).select("id", "email", "name", "first_seen", "last_seen", "commit_count")


def live_expertise(k: Knowledge) -> DataFrame:
    return ownership.expertise(_owned(k).snapshot())


def live_bm25(k: Knowledge) -> DataFrame:
    """Every document under stale words and some more, then the right ones; the others are deleted.  Ranks are those of a whole index."""
    tables = _tables(k, "index")
    documents = _docs(k).withColumn("repository_id", F.lit(REPO))
    stale = documents.withColumn("content", F.concat_ws(" ", "content", F.lit("add login once")))
    more = documents.where("entity_type = 'FACT'").withColumn("id", F.concat(F.lit("old_"), "id"))
    for rows, gone in ((stale.unionByName(more), None), (documents, more.select("repository_id", "id"))):
        change = tables.change()
        search_index.apply(change, rows, gone)
        change.commit()
    return search.bm25(search_index.index(tables.snapshot(), REPO), "add login")


QUERIES |= {
    "live_contributors": (live_contributors, sql("SELECT id, email, name, first_seen, last_seen, commit_count FROM ctr", "ctr")),
    "live_expertise": (live_expertise, sql("SELECT * FROM exp", "exp")),
    "live_bm25": (live_bm25, sql("SELECT 1", "docs").removesuffix(" SELECT 1") + f", {_bm25_sql(['add', 'login'])} SELECT id, entity_type, rank FROM hits"),
}
