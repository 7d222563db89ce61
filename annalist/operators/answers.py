"""Questions, briefings and checks: driver-side routing over the operators' results, which caps keep small."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ASK_STOP_WORDS, BLOCKERS, CAPS, TASK_VERBS
from ..functions import text as t

# fixed values: what a question's form asks for, in the order they are tried
QUESTIONS = (
    ("concept", r"what is (?:the )?(?:struct |type |function )?(.+?)"),
    ("concept", r"what does (?:the )?(.+?) do"),
    ("concept", r"how does (?:the )?(.+?) work"),
    ("concept", r"tell me about (?:the )?(.+?)"),
    ("ownership", r"who owns\s+(.+?)"),
    ("authorship", r"who created\s+(.+?)"),
    ("authorship", r"who worked on\s+(.+?)"),
    ("authorship", r"who touched\s+(.+?)"),
    ("rationale", r"why (?:are we |do we )?(?:use|using|uses|used)\s+(.+?)"),
    ("dependency", r"what depends on\s+(.+?)"),
)
# fixed values: questions that name an entity
STRICT = (
    ("overview", r"what is this repository()"),
    ("overview", r"show repository overview()"),
    ("decision_guidance", r"why was decision\s+([a-zA-Z0-9_\-]+)\s+made"),
    ("decision_guidance", r"what supports decision\s+([a-zA-Z0-9_\-]+)"),
    ("event_guidance", r"what caused event\s+([a-zA-Z0-9_\-]+)"),
    ("event_guidance", r"why did event\s+([a-zA-Z0-9_\-]+)\s+happen"),
    ("decision_impact", r"what happens if decision\s+([a-zA-Z0-9_\-]+)\s+changes"),
    ("fact_impact", r"what depends on fact\s+([a-zA-Z0-9_\-]+)"),
    ("intent_impact", r"what happens if intent\s+([a-zA-Z0-9_\-]+)\s+changes"),
    ("event_impact", r"what is the impact of event\s+([a-zA-Z0-9_\-]+)"),
)


@dataclass(frozen=True)
class Route:
    kind: str
    subject: str


def is_task(text: str) -> bool:
    """Whether a text reads like a piece of work and not like a question."""
    text = text.strip()
    low = text.lower()
    return bool(text) and (low.startswith(tuple(v + " " for v in TASK_VERBS)) or bool(re.match(r"(?i)[A-Z][A-Z0-9]+-\d+", text)) or text.count("\n") >= 2 or "as a user" in low or "acceptance criteria" in low or len(text.split()) >= 12)


def task_topic(text: str) -> str:
    """Without the ticket's number."""
    return re.sub(r"(?i)^[A-Z][A-Z0-9]+-\d+:\s*", "", text.strip()).strip()


def route(question: str) -> Route:
    """What a question asks for: a task, then by its form, then an entity by id, else a search."""
    text = question.strip()
    if not text:
        raise ValueError("an empty question")
    if is_task(text):
        return Route("task", task_topic(text))
    for kind, pattern in (*QUESTIONS, *STRICT):
        if m := re.fullmatch(rf"(?i){pattern}\??", text):
            return Route(kind, m[1].strip())
    return Route("search", text)


def strict_route(question: str) -> Route | None:
    """A question by id alone (the strict form of questions), whatever else it could mean."""
    for kind, pattern in STRICT:
        if m := re.fullmatch(rf"(?i){pattern}\??", question.strip()):
            return Route(kind, m[1])
    return None


def ask_terms(question: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", question.lower()) if len(w) >= 3 and w not in ASK_STOP_WORDS))


def rationale(content: Column, most: int = 280) -> Column:
    """The lines below ## Context, Rationale or Decision up to the next ##; else the first three lines of text; cut at ``most`` characters."""
    lines = F.filter(F.transform(F.split(content, "\n"), t.squeeze), lambda x: x != "")
    opens = lambda x: F.lower(x).rlike(r"^## (?:context|rationale|decision)")
    state = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("s"), F.array().cast("array<string>").alias("body")),
        lambda a, x: F.when(a["s"] == 2, a)
        .when(opens(x), F.struct(F.lit(1).alias("s"), a["body"].alias("body")))
        .when((a["s"] == 1) & x.startswith("## "), F.struct(F.lit(2).alias("s"), a["body"].alias("body")))
        .when(a["s"] == 1, F.struct(a["s"].alias("s"), F.concat(a["body"], F.array(x)).alias("body")))
        .otherwise(a),
    )["body"]
    first = F.slice(F.filter(lines, lambda x: ~x.startswith("#")), 1, 3)
    text = t.squeeze(F.regexp_replace(F.array_join(F.when(F.size(state) > 0, state).otherwise(first), " "), r"(?U)\s+", " "))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def ship_blockers(items: DataFrame) -> DataFrame:
    """Items (id, text) that name something risky, and the first such word."""
    low = F.lower("text")
    word = F.coalesce(*[F.when(low.contains(w), w) for w in BLOCKERS])
    return items.select("id", word.alias("blocker")).where("blocker IS NOT NULL")


def advisories(expertise: list[str], reviewers: list[str], areas: list[str], knowledge: list[str]) -> list[tuple[str, str]]:
    """(category, message) of what a change's author should look at.  Fixed values: the messages."""
    out = []
    if expertise and not reviewers:
        out.append(("ownership", "Domain expertise detected but no reviewers recommended — confirm owners before merge"))
    if len(areas) >= 3:
        out.append(("impact", "Wide blast radius across multiple dependent areas — run targeted verification"))
    if knowledge:
        out.append(("knowledge", "Review related decisions and facts in structured output before ship"))
    if areas:
        out.append(("rollback", "Define rollback or feature-flag plan for production-impacting changes"))
    return out


def traces(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """(decision_id, intents, events, facts): what drives, follows and supports each decision."""
    into = edges.where("relationship_type IN ('INTENT_DRIVES_DECISION', 'FACT_SUPPORTS_DECISION')").select(F.col("to_id").alias("decision_id"), "relationship_type")
    out = edges.where("relationship_type = 'DECISION_RESULTS_IN_EVENT'").select(F.col("from_id").alias("decision_id"), "relationship_type")
    count = lambda kind: F.sum(F.when(F.col("relationship_type") == kind, 1).otherwise(0)).alias
    found = into.unionByName(out).groupBy("decision_id").agg(count("INTENT_DRIVES_DECISION")("intents"), count("DECISION_RESULTS_IN_EVENT")("events"), count("FACT_SUPPORTS_DECISION")("facts"))
    return decisions.select(F.col("id").alias("decision_id")).join(found, "decision_id", "left").fillna(0)


def trace_counts(decisions: DataFrame, counts: DataFrame) -> DataFrame:
    """The same from the counts of ``link.link_counts``."""
    own = {"intents": ("INTENT_DRIVES_DECISION", False), "events": ("DECISION_RESULTS_IN_EVENT", True), "facts": ("FACT_SUPPORTS_DECISION", False)}
    sums = [F.sum(F.when((F.col("relationship_type") == kind) & (F.col("outgoing") == out), F.col("n")).otherwise(0)).alias(name) for name, (kind, out) in own.items()]
    found = counts.groupBy(F.col("id").alias("decision_id")).agg(*sums)
    return decisions.select(F.col("id").alias("decision_id")).join(found, "decision_id", "left").fillna(0)


def capped(items: list, kind: str) -> tuple[list, int]:
    """The first items that an answer may hold, and how many it leaves out; no room is none."""
    most = CAPS[kind]
    return items[:most], max(0, len(items) - most)


def truncated(text: str, budget: int) -> str:
    """At most ``budget`` tokens of four characters."""
    return text if len(text) <= 4 * budget else text[: max(0, 4 * budget - 3)] + "..."


def section(name: str, source: str, rows: DataFrame, *order: str) -> DataFrame:
    """One row (name, source, data): the rows as JSON in a total order; callers cap the rows."""
    listed = rows.select(F.struct(*order, *[c for c in rows.columns if c not in order]).alias("r")).agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("data"))
    return listed.select(F.lit(name).alias("name"), F.lit(source).alias("source"), "data")


def markdown(title: str, lists: dict[str, list[str]]) -> str:
    """A document of the lists that have items; an error if none has."""
    if not any(lists.values()):
        raise ValueError("nothing to export")
    return "\n".join([f"# {title}", *[line for name, items in lists.items() if items for line in ("", f"## {name}", "", *[f"- {x}" for x in items])], ""])


def handoff(facts: list[dict]) -> str:
    """Remembered facts as a versioned bundle, sorted by id."""
    return json.dumps({"version": 1, "facts": sorted(facts, key=lambda f: f["id"])}, sort_keys=True)
