"""Answers made of several operators' rows: entity briefings, symbols, explanations, plans, impact, sessions and workflows.

Rows are (section, entity_type, id, label) unless said otherwise.  Inputs that come from a topic are few and checkpointed by the caller.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from . import graph, readers, topics
from .code import entity_role, symbol_dependencies, symbol_matches
from .rank import numbered

# fixed values: which entities get a briefing, in this order, how many, and how long their lists are
ROOTS = ("struct", "interface", "type_alias", "function", "method", "file")
MOST_BRIEFINGS, MOST_REFS = 8, 6
# fixed values: where a call graph starts; types of one short name that is used more than once need a package
CALL_ROOTS = ("function", "method", "struct")
RELATED = ("CALLS", "REFERENCES", "DEPENDS_ON")
# fixed values: kinds of artifacts and workflows
WORKFLOWS = {
    "onboarding": ("session", "discovery_report", "learning_path"),
    "review_preparation": ("session", "reviewer_report", "search_result", "context_package"),
    "change_preparation": ("session", "change_plan", "search_result", "context_package"),
    "knowledge_exploration": ("session", "search_result"),
}
SOURCES = {"session": "session", "context_package": "context", "search_result": "search", "discovery_report": "discovery", "learning_path": "learning", "reviewer_report": "reviewers", "change_plan": "changeplan"}


def _rows(rows: DataFrame, section: str, kind: str, key: str, label: str) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.col(kind).alias("entity_type") if kind in rows.columns else F.lit(kind).alias("entity_type"), F.col(key).alias("id"), F.col(label).alias("label"))


def _listed(rows: DataFrame, *order: str) -> DataFrame:
    """(root, names): the first labels of each root in an order, sorted by type, label and id."""
    place = F.row_number().over(Window.partitionBy("root").orderBy(*order))
    few = rows.withColumn("_n", place).where(F.col("_n") <= MOST_REFS)
    return few.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entity_type", "label", "id"))), lambda x: x["label"]), ",").alias("names"))


def briefing_roots(entities: DataFrame, most: int = MOST_BRIEFINGS) -> DataFrame:
    """The first entities by type and name that a briefing is written about, with their position."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ROOTS]), F.col("entity_type"))
    first = entities.withColumn("_rank", rank).where("_rank > 0").dropDuplicates(["id"]).orderBy("_rank", "qualified_name", "id").limit(most)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("_rank", "qualified_name", "id"))).alias("all"))  # at most ``most`` rows
    place = listed.select(F.posexplode("all").alias("position", "r")).select((F.col("position") + 1).alias("position"), "r.id")
    return first.drop("_rank").join(F.broadcast(place), "id")


def briefings(own: DataFrame, entities: DataFrame, relations: DataFrame, links: DataFrame, most: int = MOST_BRIEFINGS) -> DataFrame:
    """One row for each of the first entities of ``own``: what it is, where, its fields and members, who calls it, what it uses, decisions.

    links: (code_id, memory_id, label) of decisions.  Only the roots, at most ``most``, are broadcast; all else is joined to them.
    """
    roots = cut(briefing_roots(own, most))
    few = F.broadcast(roots.select(F.col("id").alias("root"), F.col("package_path").alias("_package"), F.col("name").alias("_name"), F.col("entity_type").alias("_type")))
    prefix = F.concat("_package", F.lit("."), "_name", F.lit("."))
    methods = entities.where("entity_type = 'method'").join(few.where("_type = 'struct'"), F.col("qualified_name").startswith(prefix))
    members = _listed(methods.select("root", "entity_type", F.col("qualified_name").alias("label"), "id", "package_path"), "package_path", "label", "id")

    def refs(here: str, there: str) -> DataFrame:
        near = relations.where(F.col("relationship_type").isin(*RELATED)).join(few.select("root"), F.col(here) == F.col("root"))
        one = near.groupBy("root", F.col(there).alias("id")).agg(F.min("relationship_type").alias("relationship_type"))
        named = one.join(entities.select("id", "entity_type", F.col("qualified_name").alias("label")), "id")
        return _listed(named, "relationship_type", "id")

    told = links.join(few.select("root"), F.col("code_id") == F.col("root")).select("root", F.lit("DECISION").alias("entity_type"), F.col("memory_id").alias("id"), "label").distinct()
    out = roots
    for name, rows in (("members", members), ("producers", refs("to_id", "from_id")), ("consumers", refs("from_id", "to_id")), ("decisions", _listed(told, "id"))):
        out = out.join(rows.select(F.col("root").alias("id"), F.col("names").alias(name)), "id", "left")
    have = lambda c, kind="string": F.col(c) if c in roots.columns else F.lit(None).cast(kind)
    place = F.when((have("start_line", "int") > 0) & (have("end_line", "int") > 0), F.format_string("%s:%d-%d", "file_path", have("start_line", "int"), have("end_line", "int"))).otherwise(F.coalesce("file_path", F.lit("")))
    signature = F.trim(F.coalesce(have("signature"), F.lit("")))
    fields = F.when(F.col("entity_type").isin("struct", "interface"), F.filter(F.transform(F.split(signature, "; "), F.trim), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    role = entity_role(F.col("entity_type"), F.col("name"), F.col("package_path"))
    lists = [F.coalesce(c, F.lit("")).alias(c) for c in ("members", "producers", "consumers", "decisions")]
    return out.select("position", "qualified_name", "entity_type", F.col("package_path").alias("layer"), role.alias("role"), place.alias("defined_in"), signature.alias("signature"), F.array_join(fields, "; ").alias("fields"), *lists)


def code_context(entities: DataFrame, own: DataFrame, relations: DataFrame) -> DataFrame:
    """The code side of an explanation: entities by kind, and of the first root its dependencies and call graph to depth 10."""
    rank = F.array_position(F.array(*[F.lit(k) for k in CALL_ROOTS]), F.col("entity_type"))
    root = cut(own.withColumn("_rank", rank).where("_rank > 0").orderBy("_rank", "qualified_name", "id").limit(1).select("id"))
    ahead = symbol_dependencies(relations).join(F.broadcast(root), F.col("from_id") == F.col("id"), "left_semi")
    calls = graph.call_graph(relations, root)
    named = lambda rows: rows.join(entities.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("label")), "to_id", "left")
    edges = calls.select(F.concat("from_id", F.lit(">"), "to_id").alias("id"), "to_id").distinct()
    return graph.union_all([
        _rows(own, "code", "entity_type", "id", "qualified_name"),
        _rows(named(ahead.select("to_id", "relationship_type").distinct()), "dependencies", "relationship_type", "to_id", "label"),
        _rows(named(edges), "call_graph", "CALLS", "id", "label"),
    ])


def resolve_symbol(entities: DataFrame, relations: DataFrame, symbol: str, package: str = "") -> DataFrame:
    """A symbol's matches, the other entities of its file, its dependencies and call graph.

    A short name that several entities have (no point or slash in it) needs the package: without one it is an error, as is no match.
    """
    found = cut(symbol_matches(entities, symbol, package).orderBy("qualified_name", "id"))
    names = found.select("id", "file_path", F.lower("name").alias("name")).limit(2).collect()
    if not names:
        raise LookupError(f"{symbol!r} not found")
    if len(names) > 1 and not package and not set("./") & set(symbol) and not found.where(F.lower("name") == symbol.lower()).isEmpty():
        raise ValueError(f"{symbol!r} is the name of several entities: name its package")
    root = found.orderBy("qualified_name", "id").limit(1)
    beside = entities.join(F.broadcast(root.select("file_path").where("file_path <> ''")), "file_path", "left_semi")
    own = found.select(*entities.columns).unionByName(beside.select(*entities.columns)).dropDuplicates(["id"])
    return code_context(entities, root.select(*entities.columns), relations).where("section <> 'code'").unionByName(_rows(own, "code", "entity_type", "id", "qualified_name"))


def explain(resolved: DataFrame, entities: DataFrame, relations: DataFrame, known: DataFrame, bridge: DataFrame) -> DataFrame:
    """Both sides of a topic: its code, with the first root's dependencies and calls; what memories know; the links between the two.

    resolved: (side, id); known: (entity_id, entity_type, label); bridge: (relationship_type, memory_id, code_id).
    """
    own = entities.join(resolved.where("side = 'code'").select("id"), "id", "left_semi")
    linked = bridge.join(resolved.where("side = 'repository'").select(F.col("id").alias("memory_id")), "memory_id", "left_semi").join(resolved.where("side = 'code'").select(F.col("id").alias("code_id")), "code_id", "left_semi")
    return graph.union_all([code_context(entities, own, relations), _rows(known, "repository", "entity_type", "entity_id", "label"), _rows(linked.distinct(), "links", "relationship_type", "memory_id", "code_id")])


def topic_impact(resolved: DataFrame, known: DataFrame, nodes: DataFrame, edges: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """What a change of a topic touches: memories on any path of up to 10 edges from its own ones, dependent areas, code it relates to.

    nodes(id, node_type, entity_id) and edges(from_node_id, to_node_id) of the knowledge graph.  A node lies on such a path exactly if it is
    within that distance, so each is visited once.  Intents and contributors on the way are not reported.
    """
    seeds = known.where("entity_type IN ('DECISION', 'FACT', 'EVENT')").select("entity_id", F.col("entity_type").alias("node_type"))
    starts = nodes.join(seeds, ["entity_id", "node_type"], "left_semi").select("id")
    reached = graph.reach(edges.select(F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id")), cut(starts)).select("id")
    touched = nodes.join(reached, "id", "left_semi").select("node_type", "entity_id").unionByName(known.select(F.col("entity_type").alias("node_type"), "entity_id")).distinct()
    section = F.when(F.col("node_type") == "DECISION", "impacted_decisions").when(F.col("node_type") == "FACT", "impacted_facts").when(F.col("node_type") == "EVENT", "impacted_events").when(F.col("node_type") == "EXPERTISE", "dependent_areas")
    memory = touched.select(section.alias("section"), F.col("node_type").alias("entity_type"), F.col("entity_id").alias("id"), F.col("entity_id").alias("label")).where("section IS NOT NULL")
    code = topics.with_siblings(resolved.where("side = 'code'").select("id"), entities)
    areas = _rows(code.where("entity_type IN ('file', 'package')"), "dependent_areas", "entity_type", "id", "qualified_name")
    out = relations.join(code.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("relationship_type", "from_id", "to_id").distinct()
    return graph.union_all([memory, areas, _rows(out, "code_relations", "relationship_type", "from_id", "to_id")])


def plan(resolved: DataFrame, entities: DataFrame, known: DataFrame, expertise: DataFrame, nodes: DataFrame, edges: DataFrame, reviewers: DataFrame | None = None, learning: DataFrame | None = None) -> DataFrame:
    """What a task starts from: impacted areas, starting points, decisions and facts, owners, reviewers.

    expertise: of ``topics.match_expertise``; reviewers: (contributor_id, name); learning: (entity_type, entity_id) of a domain's path.
    The first decision's change plan (the smallest id) adds to the areas.  ``topics.plan_steps`` words the steps from the counts.
    """
    code = topics.with_siblings(resolved.where("side = 'code'").select("id"), entities)
    first = known.where("entity_type = 'DECISION'").agg(F.min("entity_id").alias("entity_id")).withColumn("node_type", F.lit("DECISION"))
    start = cut(nodes.join(F.broadcast(first), ["entity_id", "node_type"], "left_semi").select("id"))
    reached = graph.reach(edges.select(F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id")), start)
    changed = reached.where("hops > 0").join(nodes.where("node_type IN ('DECISION', 'FACT', 'EVENT', 'CONTRIBUTOR')"), "id").select(F.col("node_type").alias("kind"), "entity_id")
    decisions = known.where("entity_type = 'DECISION'")
    parts = [
        _rows(code.where("entity_type <> 'endpoint'"), "impacted_areas", "entity_type", "id", "qualified_name"),
        _rows(code.where("entity_type NOT IN ('endpoint', 'package')"), "starting_points", "entity_type", "id", "qualified_name"),
        _rows(known.where("entity_type = 'EXPERTISE'"), "impacted_areas", "entity_type", "entity_id", "label"),
        _rows(changed, "impacted_areas", "kind", "entity_id", "entity_id"),
        _rows(decisions, "relevant_decisions", "entity_type", "entity_id", "label"),
        _rows(decisions, "starting_points", "entity_type", "entity_id", "label"),
        _rows(known.where("entity_type = 'FACT'"), "relevant_facts", "entity_type", "entity_id", "label"),
        _rows(expertise, "owners", "kind", "id", "label"),
    ]
    if reviewers is not None:
        parts.append(_rows(reviewers, "reviewers", "CONTRIBUTOR", "contributor_id", "name"))
    if learning is not None:
        parts.append(_rows(learning, "starting_points", "entity_type", "entity_id", "entity_id"))
    # an entity is in a section once: under the label that names it, where one does
    return graph.union_all(parts).groupBy("section", "entity_type", "id").agg(F.max_by("label", F.struct(F.col("label") != F.col("id"), "label")).alias("label"))


# fixed values: the steps of a first day
FIRST_STEPS = ("Read orientation summary and key decisions.", "Use explain on domains you will touch.", "For assignments, follow assignment_plan suggested_steps.", "Run analyze_topic_impact before broad refactors.", "Run review before merge.")


def onboard(decisions: DataFrame, orientation: DataFrame, assignment: list[str] = ()) -> DataFrame:
    """(section, position, text) of a first day: the first decisions by title, the overview's counts (kind, n), the steps and an assignment's steps."""
    steps = [f"{n}. {text}" for n, text in enumerate(FIRST_STEPS, 1)] + (["Assignment steps:", *assignment] if assignment else [])
    key = topics.onboarding(decisions).select(F.lit("key_decisions").alias("section"), "position", F.col("title").alias("text"))
    seen = orientation.select(F.lit("orientation").alias("section"), F.lit(1).alias("position"), F.concat("kind", F.lit(": "), F.col("n").cast("string")).alias("text"))
    told = decisions.sparkSession.createDataFrame([("steps", n, x) for n, x in enumerate(steps, 1)], "section string, position int, text string")
    return graph.union_all([key, seen, told])


def package_id(prefix: str, repository_id: str, kind: str, identifier: str) -> str:
    return f"{prefix}_{hashlib.sha256(f'{repository_id}:{kind}:{identifier}'.encode()).hexdigest()}"


# fixed values: the sections of contexts and where they come from
OVERVIEW, DISCOVERY, LEARNING, REVIEWERS, CHANGES = ("Overview", "context"), ("Discovery", "discovery"), ("Learning Path", "learning"), ("Reviewer Recommendations", "reviewers"), ("Change Plan", "changeplan")
CONTEXTS = {"repository": (OVERVIEW, DISCOVERY, LEARNING, REVIEWERS), "domain": (OVERVIEW, LEARNING, REVIEWERS), "contributor": (OVERVIEW, LEARNING, CHANGES)}
ITEM = ("entity_type", "id", "label", "score", "by", "then")


def items(rows: DataFrame, entity_type: str, key: str, label: str | None = None, score: str | None = None, by: Column | None = None, then: Column | None = None) -> DataFrame:
    """rows in the columns of ITEM; by, then: what comes first in a section, before type, id and label (the highest score, if there is one)."""
    kind = F.col(entity_type) if entity_type in rows.columns else F.lit(entity_type)
    value = F.col(score).cast("double") if score else F.lit(None).cast("double")
    return rows.select(kind.alias("entity_type"), F.col(key).alias("id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), value.alias("score"), F.coalesce((by if by is not None else -value).cast("double"), F.lit(0.0)).alias("by"), (F.lit(0.0) if then is None else then).cast("double").alias("then"))


def context(kind: str, parts: list[DataFrame]) -> DataFrame:
    """A repository's, domain's or contributor's context: its sections' rows (of ``items``) in their fixed order, whole."""
    if kind not in CONTEXTS or len(parts) != len(CONTEXTS[kind]):
        raise ValueError(f"a {kind} context has other sections")
    named = [(f"{kind.title()} {name}" if (name, source) == OVERVIEW else name, source) for name, source in CONTEXTS[kind]]
    return graph.union_all([p.select(F.lit(n).alias("_section"), F.lit(name).alias("section"), F.lit(source).alias("source"), *ITEM) for n, (p, (name, source)) in enumerate(zip(parts, named, strict=True), 1)])


def result(kind: str, rows: DataFrame) -> DataFrame:
    """A single result (a search's, a report's, a path's) as the one section of an artifact."""
    return rows.select(F.lit(1).alias("_section"), F.lit("").alias("section"), F.lit(SOURCES[kind]).alias("source"), *ITEM)


def _packaged(prefix: str, kind: str, repository_id: str, identifier: str, artifacts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows (package_id, package_type, artifact, artifact_type, section, source, items): artifacts in their order."""
    head = [F.lit(package_id(prefix, repository_id, kind, identifier)).alias("package_id"), F.lit(kind).alias("package_type")]
    return graph.union_all([rows.select(*head, F.lit(n).alias("artifact"), F.lit(name).alias("artifact_type"), "_section", "section", "source", *ITEM) for n, (name, rows) in enumerate(artifacts, 1)])


def session(kind: str, repository_id: str, identifier: str, context: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """A session of a repository (its context alone), a domain or a contributor (context and search result).  An empty name is an error."""
    if not repository_id or kind not in ("repository", "domain", "contributor") or (kind != "repository" and (not identifier or found is None)):
        raise ValueError("a session needs a repository, a kind and what it is about")
    parts = [("context_package", context)]
    if kind != "repository":
        parts.append(("search_result", result("search_result", found)))
    return _packaged("ses", kind, repository_id, "default" if kind == "repository" else identifier, parts)


def workflow(kind: str, repository_id: str, identifier: str, parts: dict[str, DataFrame]) -> DataFrame:
    """A workflow's artifacts in their fixed order; parts: by kind of artifact: a session, a context, else rows of ``items``.  A missing part or
    an empty question is an error."""
    wanted = WORKFLOWS.get(kind)
    if wanted is None or not repository_id or (kind != "onboarding" and not identifier.strip()):
        raise ValueError("a workflow needs a repository, a kind and what it is about")
    if missing := [w for w in wanted if w not in parts]:
        raise ValueError(f"missing: {', '.join(missing)}")
    return _packaged("wrk", kind, repository_id, "default" if kind == "onboarding" else identifier, [(w, parts[w] if w in ("session", "context_package") else result(w, parts[w])) for w in wanted])


def delivered(package: DataFrame, stored: bool = False) -> DataFrame:
    """A context's, session's or workflow's rows with their place in it: all rows, in order of artifact and section, then by rank, type, id and label.

    stored: all parts are of stored tables, or as cheap to read again.
    """
    order = [c for c in ("artifact", "_section") if c in package.columns]
    return numbered(package, *order, "by", "then", "entity_type", "id", "label", stored=stored).drop("by", "then", "_section")


def known_entities(resolved: DataFrame, decisions: DataFrame, facts: DataFrame, events: DataFrame, expertise: DataFrame) -> DataFrame:
    return readers.resolve(resolved.where("side = 'repository'").select("id"), decisions, facts, events, expertise)
