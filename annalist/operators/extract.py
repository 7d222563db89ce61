"""Events, decisions, intents and facts from raw sources; narrow plans, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import INTENT_WORDS
from ..functions import text as t


def event_of(title: Column) -> Column:
    """Array of the one struct(event_type, title) that a classified commit title gives; empty where it is of no known kind or nothing follows the colon."""
    made = lambda x: t.once(t.commit_event(x), lambda kind: F.when(kind.isNotNull(), F.struct(kind.alias("event_type"), t.commit_title(x).alias("title"))))
    return F.filter(F.transform(F.array(title), made), lambda x: x["title"] != "")


def events(sources: DataFrame) -> DataFrame:
    """One event per classified commit.

    The rules run inside the generator, so that the filter and later projections don't evaluate them again; commits of no known kind get no title.
    """
    return (
        sources.where("source_type = 'commit'")
        .select("repository_id", F.col("id").alias("source_id"), F.explode(event_of(F.col("title"))).alias("found"), F.col("title").alias("description"), "ts")
        .select("repository_id", "source_id", "found.event_type", "found.title", "description", "ts")
        .withColumn("id", t.sha_key("evt_", F.lit("event"), "repository_id", "source_id"))
    )


def decisions(sources: DataFrame) -> DataFrame:
    """One decision per decision record or architecture document."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("Proposed"))
    return sources.where("source_type IN ('adr', 'architecture_doc')").select(t.sha_key("decision_", "id").alias("id"), "repository_id", "title", status.alias("status"), F.col("id").alias("source_id"), "reference", "content")


def _statements(sources: DataFrame, kinds: tuple[str, ...], rule, words: tuple[str, ...], or_title: bool, own: dict[str, str] | None = None, wanted=None) -> DataFrame:
    """(repository_id, source_id, found): what a rule finds in each statement of a source's content; of its title where that is empty, if or_title.

    words: of which a statement must hold one for the rule to find anything; no statement goes beyond its line, so lines without them, whatever
    the case, are not cut up.  own: the source's columns to return instead of the first two, by their names there.  wanted: a further test of
    lines and of statements, of (text, text lower-cased); what it refuses in a line it must refuse in each statement of the line.

    Lines and statements become rows and are lower-cased in a step of their own, so that their tests are compiled code that reads each once.
    The rule runs inside the generator, so that later projections and filters don't evaluate it again.
    """
    text = F.when(F.col("source_type") == "commit", F.col("title")).otherwise(F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("title") if or_title else F.lit("")))
    own = {"repository_id": "repository_id", "id": "source_id"} if own is None else own
    test = t.holds(F.col("low"), words)
    if wanted is not None:
        test = test & wanted(F.col("part"), F.col("low"))

    def parts(rows: DataFrame, made: Column) -> DataFrame:
        return rows.select(*own.values(), F.explode(made).alias("part")).withColumn("low", F.lower("part")).select(*own.values(), F.explode(F.when(test, F.array("part"))).alias("part"))

    lines = parts(sources.where(F.col("source_type").isin(*kinds)).select(*[F.col(c).alias(n) for c, n in own.items()], text.alias("text")), F.split("text", "\n"))
    return parts(lines, t.segments(F.col("part"))).select(*own.values(), F.explode(F.array_compact(F.array(rule(F.col("part"))))).alias("found"))


def stated(sources: DataFrame, own: dict[str, str] | None = None, wanted=None) -> DataFrame:
    """Subject, predicate and object of each statement that states one, with the source's own columns (see ``_statements``); a row for each time it is said."""
    found = _statements(sources, ("adr",), t.fact, t.FACT_WORDS, False, own, wanted)
    return found.select(*[c for c in found.columns if c != "found"], "found.*").where("subject <> '' AND object <> ''")


def facts(sources: DataFrame) -> DataFrame:
    """Subject, predicate and object of each statement that states one; equal facts of one source are one row."""
    return stated(sources).withColumn("id", t.sha_key("fact_", F.concat("source_id", "subject", "predicate", "object"))).dropDuplicates(["id"])


def intents(sources: DataFrame) -> DataFrame:
    found = _statements(sources, ("adr", "commit"), t.intent, INTENT_WORDS, True).withColumnRenamed("found", "description")
    return found.withColumn("id", t.sha_key("intent_", "source_id", F.lower("description"))).dropDuplicates(["id"])
