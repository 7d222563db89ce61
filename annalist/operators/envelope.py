"""Envelopes of answers: rows in a stable order, cut to what an answer may hold, what was left out by section, and how to use the rest.

Input rows are (section, entity_type, id, label), as the operators of ``packages`` and ``topics`` give them.  Output rows are (part, section,
position, entity_type, id, label, n):

* item: a row that is kept, with its place in its section;
* omitted: how many rows of a section are left out (n); none where all are kept;
* meta: kind, completeness, whether it must be read before an edit, what guides its reader and which tools come next, in label.

Places come from one sort by ranges over all sections (``rank.numbered``), so a long section is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..storage import cut
from .graph import union_all
from .packages import ROOTS
from .rank import numbered

# fixed values: for each kind of answer the most rows of its sections and the name under which what is left out is told; sections not named are whole
CAPS = {
    "unified_explanation": {"evidence": (20, "evidence"), "links": (12, "repository_code_links")},
    "plan": {"starting_points": (8, "starting_points"), "impacted_areas": (15, "impacted_areas"), "relevant_decisions": (15, "relevant_decisions"), "evidence": (20, "evidence"), "links": (12, "repository_code_links")},
    "impact": {"dependent_areas": (15, "impacted_areas"), "evidence": (20, "evidence"), "links": (12, "repository_code_links")},
    "review": {"discipline_checks": (12, "discipline_checks"), "affected_areas": (15, "impacted_areas"), "evidence": (20, "evidence")},
    "reuse_check": {"reuse_candidates": (15, "reuse_candidates"), "related_decisions": (15, "related_decisions"), "evidence": (20, "evidence")},
    "ship_check": {"ship_blockers": (10, "ship_blockers"), "advisories": (10, "advisories"), "impacted_areas": (15, "impacted_areas"), "evidence": (20, "evidence")},
}
# fixed values: what guides a reader
EVIDENCE_ONLY = ("Cite only facts present in structured — do not invent paths, types, or ADRs.", "If a fact is missing, say so and use recommended_next_tools — do not guess.")
FEW_TOKENS = ("Prefer structured fields over bulk file reads when completeness is full.",)
GUIDANCE = {
    "unified_explanation": ("Combine entity_briefings with code_context and repository_context.", "Honor repository_code_links when connecting decisions to code.", *EVIDENCE_ONLY, *FEW_TOKENS),
    "plan": (
        "Task intake: treat this plan as the scope boundary for pasted assignments.", "Implement only within impacted_areas and starting_points.", "Apply relevant_decisions as architectural constraints.",
        "Run explain/ask on unknown terms before editing if briefings are absent.", *EVIDENCE_ONLY, *FEW_TOKENS,
    ),
    "impact": ("Update dependent_areas and code_dependencies when refactoring.", "Re-run impact after substantive changes.", *EVIDENCE_ONLY),
    "review": ("Verify affected_areas and related_knowledge before merge.", "Involve recommended_reviewers when expertise is required."),
    "reuse_check": ("Reuse Protocol: extend reuse_candidates before writing new code.", "Use defined_in and explain_function / explain_file to verify fit.", *EVIDENCE_ONLY),
    "ship_check": ("Ship Readiness: resolve ship_blockers before merge.", "Treat advisories as required pre-ship checks unless ruled out with evidence.", *EVIDENCE_ONLY),
}
COMPARE = "Compare briefings before choosing a symbol to edit."
CHECKS = "Apply discipline_checks from repository policy before merge."
# fixed values: the tools that come next, by completeness where it matters
TOOLS = {"unified_explanation": {"full": ("plan", "analyze_topic_impact"), "partial": ("explain_struct", "explain_function", "ask"), "retrieval_only": ("ask", "explain")}, "plan": ("analyze_topic_impact", "explain_file", "review"), "impact": ("plan", "review")}
#: Sections whose rows make an answer full; for others partial is enough, and an explanation without any is retrieval only.
FULL = {"plan": ("starting_points",), "impact": ("dependent_areas", "code_relations"), "reuse_check": ("reuse_candidates",), "ship_check": ("advisories", "impacted_areas")}
BRIEFED = tuple(k for k in ROOTS if k != "file")
SCHEMA = "part string, section string, position long, entity_type string, id string, label string, n long"


def _place(rows: DataFrame) -> DataFrame:
    """rows with their place in their section, by type (those that get briefings first), label and id, and the section's size."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ROOTS]), F.col("entity_type"))
    all_rows = numbered(rows.withColumn("_type", F.when(rank == 0, len(ROOTS) + 1).otherwise(rank)), "section", "_type", F.asc_nulls_last("label"), "id", name="_p")
    spans = all_rows.groupBy("section").agg(F.min("_p").alias("_least"), F.count(F.lit(1)).alias("total"))  # a row for each section
    return all_rows.join(F.broadcast(spans), "section").select("section", "entity_type", "id", "label", (F.col("_p") - F.col("_least") + 1).alias("position"), "total")


def meta(kind: str, sizes: DataFrame, briefed: DataFrame) -> DataFrame:
    """The meta rows; sizes: (section, total), a row for each section; briefed: one row (n) of entities that get briefings."""
    have = {r.section for r in sizes.collect()}  # as many as an answer has sections
    n = briefed.first()["n"]
    if kind == "unified_explanation":
        completeness = "full" if n else "partial" if have else "retrieval_only"
        must, tools = n > 0, TOOLS[kind][completeness]
    elif kind == "ship_check":
        completeness = "partial" if "ship_blockers" in have or not have & set(FULL[kind]) else "full"
        must, tools = "ship_blockers" in have, ()
    else:
        completeness = "full" if kind == "review" or have & set(FULL.get(kind, ())) else "partial"
        must, tools = kind != "review", TOOLS.get(kind, ())
    guidance = [*GUIDANCE[kind], *([COMPARE] if kind == "unified_explanation" and n > 1 else []), *([CHECKS] if kind == "review" and "discipline_checks" in have else [])]
    said = [("kind", 1, kind), ("completeness", 1, completeness), ("must_use_before_edit", 1, str(must).lower())]
    said += [("guidance_for_agent", i, x) for i, x in enumerate(guidance, 1)] + [("recommended_next_tools", i, x) for i, x in enumerate(tools, 1)]
    return sizes.sparkSession.createDataFrame([("meta", a, i, None, None, x, None) for a, i, x in said], SCHEMA)


def envelope(kind: str, rows: DataFrame, budget: int | None = None) -> DataFrame:
    """The envelope of an answer of a kind of CAPS.

    Without a budget a section holds its cap.  With one, what the caps leave is taken in the order of the kind's sections (others behind them, by name) and
    places while its tokens fit in all; a budget of n takes at most n rows, so no more are looked at.
    """
    if kind not in CAPS:
        raise ValueError(f"no envelope of kind {kind!r}")
    placed = cut(_place(rows.select("section", "entity_type", "id", "label").distinct()))
    names = list(CAPS[kind])
    cap = F.coalesce(*[F.when(F.col("section") == s, CAPS[kind][s][0]) for s in names])
    told = F.coalesce(*[F.when(F.col("section") == s, F.lit(CAPS[kind][s][1])) for s in names], F.col("section"))
    kept = placed.where(cap.isNull() | (F.col("position") <= cap))
    if budget is not None:
        place = F.array_position(F.array(*[F.lit(s) for s in names]), F.col("section"))
        order = [F.when(place == 0, len(names) + 1).otherwise(place), F.col("section"), F.col("position")]
        first = kept.withColumn("cost", F.greatest(F.lit(1), t.token_estimate(F.coalesce("label", "id")))).orderBy(*order).limit(max(0, budget))
        spent = F.sum("cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # at most ``budget`` rows
        kept = cut(first.withColumn("spent", spent).where(F.col("spent") <= budget).select(*placed.columns))
    sizes = placed.groupBy("section").agg(F.max("total").alias("total"))
    left = kept.groupBy("section").agg(F.count(F.lit(1)).alias("_k"))
    omitted = sizes.join(left, "section", "left").withColumn("n", F.col("total") - F.coalesce("_k", F.lit(0))).where("n > 0")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    items = kept.select(F.lit("item").alias("part"), "section", F.col("position").cast("long").alias("position"), "entity_type", "id", "label", none("long", "n"))
    lost = omitted.select(F.lit("omitted").alias("part"), told.alias("section"), none("long", "position"), none("string", "entity_type"), none("string", "id"), none("string", "label"), F.col("n").cast("long").alias("n"))
    briefed = rows.where(F.col("section") == "code").where(F.col("entity_type").isin(*BRIEFED)).agg(F.countDistinct("id").alias("n"))
    return union_all([items, lost, meta(kind, sizes, briefed)])


def envelope_sql(kind: str, body: str, with_list: str) -> str:
    """DuckDB SQL of ``envelope`` without a budget, over the SQL of its rows."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    case = lambda pick, other: "CASE section " + " ".join(f"WHEN {text(s)} THEN {pick(v)}" for s, v in CAPS[kind].items()) + f" ELSE {other} END"
    has = lambda *s: "EXISTS (SELECT 1 FROM env WHERE section IN (" + ", ".join(map(text, s)) + "))"
    briefed = f"(SELECT count(DISTINCT id) FROM env WHERE section = 'code' AND entity_type IN ({', '.join(map(text, BRIEFED))}))"
    full = f"{briefed} > 0" if kind == "unified_explanation" else "true" if kind == "review" else has(*FULL[kind])
    least = "CASE WHEN EXISTS (FROM env) THEN 'partial' ELSE 'retrieval_only' END" if kind == "unified_explanation" else "'partial'"
    state = f"CASE WHEN {full} THEN 'full' ELSE {least} END"
    must = f"CASE WHEN {briefed} > 0 THEN 'true' ELSE 'false' END" if kind == "unified_explanation" else "'false'" if kind == "review" else "'true'"
    said = [("kind", 1, text(kind), "true"), ("completeness", 1, state, "true"), ("must_use_before_edit", 1, must, "true")] + [("guidance_for_agent", i, text(x), "true") for i, x in enumerate(GUIDANCE[kind], 1)]
    if kind == "unified_explanation":
        said += [("guidance_for_agent", len(GUIDANCE[kind]) + 1, text(COMPARE), f"{briefed} > 1")]
        said += [("recommended_next_tools", i, text(x), f"{state} = {text(s)}") for s, tools in TOOLS[kind].items() for i, x in enumerate(tools, 1)]
    else:
        said += [("recommended_next_tools", i, text(x), "true") for i, x in enumerate(TOOLS.get(kind, ()), 1)]
    metas = " UNION ALL ".join(f"SELECT 'meta', '{a}', {i}, NULL, NULL, {x}, NULL WHERE {test}" for a, i, x, test in said)
    cap, told = case(lambda v: v[0], "NULL"), case(lambda v: text(v[1]), "section")
    rank = f"coalesce(nullif(list_position([{', '.join(map(text, ROOTS))}], entity_type), 0), {len(ROOTS) + 1})"
    return (
        f"{with_list}, env AS (SELECT DISTINCT section, entity_type, id, label FROM ({body})), placed AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY {rank}, label NULLS LAST, id) AS position, count(*) OVER (PARTITION BY section) AS total, {cap} AS cap FROM env)"
        f" SELECT 'item' AS part, section, position, entity_type, id, label, CAST(NULL AS BIGINT) AS n FROM placed WHERE cap IS NULL OR position <= cap"
        f" UNION ALL SELECT DISTINCT 'omitted', {told}, NULL, NULL, NULL, NULL, total - cap FROM placed WHERE total > cap UNION ALL {metas}"
    )
