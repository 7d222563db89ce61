"""What leads to a memory and what follows from it, one or two relations away, as rows.

Every trace starts from a table of ids and restricts the relations to them before any words are matched, so its cost follows the
ids asked for and not the number of all links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import link


def _rows(pairs: DataFrame, start: str, other: str, kind: str, labels: DataFrame, label: str) -> DataFrame:
    """(start_id, kind, entity_id, label) of pairs; the other side must exist."""
    named = labels.select(F.col("id").alias("entity_id"), F.col(label).alias("label"))
    return pairs.select(F.col(start).alias("start_id"), F.lit(kind).alias("kind"), F.col(other).alias("entity_id")).distinct().join(named, "entity_id").select("start_id", "kind", "entity_id", "label")


def _fact_labels(facts: DataFrame) -> DataFrame:
    return facts.withColumn("label", F.concat_ws(" ", "subject", "predicate", "object"))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def trace_decisions(ids: DataFrame, intents: DataFrame, decisions: DataFrame, events: DataFrame, facts: DataFrame) -> DataFrame:
    """(start_id, kind, entity_id, label): the intents and facts behind decisions(id) and the events after them."""
    own = _only(decisions, ids)
    return (
        _rows(link.intent_decision(intents, own), "to_id", "from_id", "INTENT", intents, "description")
        .unionByName(_rows(link.fact_decision(facts, own), "to_id", "from_id", "FACT", _fact_labels(facts), "label"))
        .unionByName(_rows(link.decision_event(own, events), "from_id", "to_id", "EVENT", events, "title"))
    )


def trace_events(ids: DataFrame, intents: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(start_id, kind, entity_id, label): the decisions behind events(id), and the intents behind those, each once."""
    causes = link.decision_event(decisions, _only(events, ids)).select("from_id", "to_id")
    drives = link.intent_decision(intents, _only(decisions, causes.select(F.col("from_id").alias("id")))).select(F.col("from_id").alias("intent"), F.col("to_id").alias("from_id"))
    behind = causes.join(drives, "from_id").select("intent", "to_id")
    return _rows(causes, "to_id", "from_id", "DECISION", decisions, "title").unionByName(_rows(behind, "to_id", "intent", "INTENT", intents, "description"))


def _after(drives: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """drives(start_id, id): the decisions reached and the events after them, each once."""
    follows = link.decision_event(_only(decisions, drives), events).select(F.col("from_id").alias("id"), "to_id")
    second = drives.join(follows, "id").select("start_id", "to_id")
    return _rows(drives, "start_id", "id", "DECISION", decisions, "title").unionByName(_rows(second, "start_id", "to_id", "EVENT", events, "title"))


def intent_impact(ids: DataFrame, intents: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """The decisions that intents(id) drive, and their events."""
    return _after(link.intent_decision(_only(intents, ids), decisions).select(F.col("from_id").alias("start_id"), F.col("to_id").alias("id")), decisions, events)


def fact_impact(ids: DataFrame, facts: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """The decisions that facts(id) support, and their events."""
    return _after(link.fact_decision(_only(facts, ids), decisions).select(F.col("from_id").alias("start_id"), F.col("to_id").alias("id")), decisions, events)


def reasons(trace: DataFrame, of_event: bool) -> DataFrame:
    """(start_id, position, reason): why something happened, from its trace.  Fixed values: the openings of an event's reasons.

    A decision's reasons are its intents; an event's are its decisions, then the intents behind them, by id.
    """
    if of_event:
        text = F.when(F.col("kind") == "DECISION", F.concat(F.lit("Caused by decision: "), "label")).when(F.col("kind") == "INTENT", F.concat(F.lit("Driven by intent: "), "label"))
    else:
        text = F.when(F.col("kind") == "INTENT", F.col("label"))
    rows = trace.withColumn("reason", text).where("reason IS NOT NULL")
    listed = rows.groupBy("start_id").agg(F.array_sort(F.collect_list(F.struct("kind", "entity_id", "reason"))).alias("all"))  # what one memory has
    return listed.select("start_id", F.posexplode("all").alias("position", "r")).select("start_id", (F.col("position") + 1).alias("position"), "r.reason")
