"""Registered packages of answers (briefings, symbols, explanations, plans, impact, sessions, workflows), with their SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import DOMAIN_ITEMS, ITEMS, LEARN, LEARN_CONTRIBUTOR, LEARN_DOMAIN, PERSON, QUERIES, STORED, _bm25_sql, _discovery, _domain_discovery, _items, _match_sql, _person, _tables, learning_contributor, query, reviewers_domain, reviewers_repo
from .catalog_answers import KNOWN, TASK, TOPIC, _graph, _memories, _nodes, _topic, _with
from .functions import text as t
from .operators import envelope, graph, packages, rank, readers, search, snapshot, topics, workspace
from .plans.knowledge import Knowledge
from .sources.adapters import REPO
from .storage import cut

ROLE = "entity_type || ' ' || name || ' — ' || split_part(package_path, '/', 2) || ' (public API surface)'"
CALLED = "near_calls AS (SELECT id, min(hops) AS hops FROM walk GROUP BY 1), call_edges AS (SELECT from_id, to_id FROM near_calls JOIN calls ON from_id = near_calls.id)"
WALK = "walk AS (SELECT id, 0 AS hops FROM root UNION SELECT to_id, hops + 1 FROM walk JOIN calls ON from_id = walk.id WHERE hops < 9)"
CODE = "SELECT 'dependencies' AS section, 'CALLS' AS entity_type, to_id AS id, qualified_name AS label FROM calls JOIN root ON from_id = root.id JOIN entities e ON e.id = to_id UNION ALL SELECT 'call_graph', 'CALLS', from_id || '>' || to_id, qualified_name FROM call_edges JOIN entities e ON e.id = to_id"


def _side(a: str, b: str) -> str:
    return f"SELECT root, string_agg(label, ',' ORDER BY entity_type, label, id) AS names FROM (SELECT {a} AS root, entity_type, qualified_name AS label, e.id, row_number() OVER (PARTITION BY {a} ORDER BY e.id) AS n FROM calls JOIN entities e ON e.id = {b} WHERE {a} IN (SELECT id FROM roots)) WHERE n <= 6 GROUP BY 1"


def _links(k: Knowledge) -> DataFrame:
    return k.bridge.join(k.decisions.select(F.col("id").alias("memory_id"), F.col("title").alias("label")), "memory_id").select("code_id", "memory_id", "label")


def entity_briefings(k: Knowledge) -> DataFrame:
    return packages.briefings(k.entities, k.entities, k.relations, _links(k))


QUERIES["entity_briefings"] = (
    entity_briefings,
    _with("entities", "calls", "bridge")
    + f", roots AS (SELECT *, CAST(row_number() OVER (ORDER BY list_position(['struct', 'interface', 'type_alias', 'function', 'method', 'file'], entity_type), qualified_name, id) AS INT) AS position FROM entities QUALIFY position <= 8), made AS ({_side('to_id', 'from_id')}), used AS ({_side('from_id', 'to_id')}), told AS (SELECT code_id AS root, string_agg(title, ',' ORDER BY title, memory_id) AS names FROM (SELECT code_id, memory_id, title, row_number() OVER (PARTITION BY code_id ORDER BY memory_id) AS n FROM bridge JOIN dec ON dec.id = memory_id) WHERE n <= 6 GROUP BY 1)"
    + f" SELECT position, qualified_name, entity_type, package_path AS layer, {ROLE} AS role, file_path AS defined_in, '' AS signature, '' AS fields, '' AS members, coalesce(made.names, '') AS producers, coalesce(used.names, '') AS consumers, coalesce(told.names, '') AS decisions FROM roots LEFT JOIN made ON made.root = roots.id LEFT JOIN used ON used.root = roots.id LEFT JOIN told ON told.root = roots.id",
)


def resolve_symbol(k: Knowledge) -> DataFrame:
    return packages.resolve_symbol(k.entities, k.relations, "FN12")


QUERIES["resolve_symbol"] = (
    resolve_symbol,
    _with("entities", "calls") + f", root AS (SELECT id, file_path FROM entities WHERE id = 'part:12'), {WALK}, {CALLED} {CODE} UNION ALL SELECT 'code', entity_type, id, qualified_name FROM entities WHERE file_path IN (SELECT file_path FROM root)",
)


def _known(k: Knowledge, found: DataFrame) -> DataFrame:
    return cut(packages.known_entities(found, k.decisions, k.facts, k.events, k.expertise_rows))


def explain(k: Knowledge) -> DataFrame:
    found = cut(_topic(k))
    return packages.explain(found, k.entities, k.relations, _known(k, found), k.bridge)


_TOPIC_NEEDS = ("docs", "intent", "ctr", "expid", "bridge")


def _topic_sql(*needs: str) -> str:
    """The WITH list of a topic and what is known of it, with more parts."""
    return _with(*_TOPIC_NEEDS, *needs) + TOPIC[len(_with(*_TOPIC_NEEDS)) :] + KNOWN


QUERIES["explain"] = (
    explain,
    _topic_sql("calls")
    + f", own AS (SELECT * FROM entities WHERE id IN (SELECT id FROM topic WHERE side = 'code')), root AS (SELECT id FROM own WHERE entity_type IN ('function', 'method', 'struct') ORDER BY list_position(['function', 'method', 'struct'], entity_type), qualified_name, id LIMIT 1), {WALK}, {CALLED} {CODE} UNION ALL SELECT 'code', entity_type, id, qualified_name FROM own UNION ALL SELECT 'repository', entity_type, entity_id, label FROM known UNION ALL SELECT 'links', relationship_type, memory_id, code_id FROM bridge WHERE memory_id IN (SELECT id FROM topic WHERE side = 'repository') AND code_id IN (SELECT id FROM topic WHERE side = 'code')",
)


def plan(k: Knowledge) -> DataFrame:
    found = cut(_topic(k))
    return packages.plan(found, k.entities, _known(k, found), topics.match_expertise(k.expertise_rows, TASK), *_graph(k))


def topic_impact(k: Knowledge) -> DataFrame:
    found = cut(_topic(k))
    return packages.topic_impact(found, _known(k, found), *_graph(k), k.entities, k.relations)


REACHED = "reached AS (SELECT id, 0 AS hops FROM start UNION SELECT to_node_id, hops + 1 FROM reached JOIN kgraph ON from_node_id = reached.id WHERE hops < 10)"
QUERIES |= {
    "plan": (
        plan,
        _topic_sql("kgraph", "knodes")
        + f", start AS (SELECT id FROM knodes WHERE node_type = 'DECISION' AND entity_id = (SELECT min(entity_id) FROM known WHERE entity_type = 'DECISION')), {REACHED}, own AS (SELECT * FROM entities WHERE id IN (SELECT id FROM topic WHERE side = 'code')), rows AS (SELECT unnest(['impacted_areas', 'starting_points']) AS section, entity_type, id, qualified_name AS label FROM own UNION ALL SELECT 'impacted_areas', entity_type, entity_id, label FROM known WHERE entity_type = 'EXPERTISE' UNION ALL SELECT 'impacted_areas', node_type, entity_id, entity_id FROM knodes WHERE id IN (SELECT id FROM reached) AND id NOT IN (SELECT id FROM start) AND node_type IN ('DECISION', 'FACT', 'EVENT', 'CONTRIBUTOR') UNION ALL SELECT unnest(['relevant_decisions', 'starting_points']), entity_type, entity_id, label FROM known WHERE entity_type = 'DECISION' UNION ALL SELECT 'relevant_facts', entity_type, entity_id, label FROM known WHERE entity_type = 'FACT' UNION ALL SELECT 'owners', 'EXPERTISE', id, domain FROM expid WHERE contains(lower(domain), 'm12') OR contains(lower(domain), 'fn12')) SELECT section, entity_type, id, arg_max(label, (label <> id, label)) AS label FROM rows GROUP BY 1, 2, 3",
    ),
    "topic_impact": (
        topic_impact,
        _topic_sql("kgraph", "knodes", "calls")
        + f", start AS (SELECT id FROM knodes JOIN known USING (entity_id) WHERE node_type = entity_type AND node_type IN ('DECISION', 'FACT', 'EVENT')), {REACHED}, touched AS (SELECT node_type AS kind, entity_id FROM knodes WHERE id IN (SELECT id FROM reached) UNION SELECT entity_type, entity_id FROM known) SELECT CASE kind WHEN 'DECISION' THEN 'impacted_decisions' WHEN 'FACT' THEN 'impacted_facts' WHEN 'EVENT' THEN 'impacted_events' ELSE 'dependent_areas' END AS section, kind AS entity_type, entity_id AS id, entity_id AS label FROM touched WHERE kind IN ('DECISION', 'FACT', 'EVENT', 'EXPERTISE') UNION ALL SELECT DISTINCT 'code_relations', relationship_type, from_id, to_id FROM calls WHERE from_id IN (SELECT id FROM topic WHERE side = 'code')",
    ),
}



def explain_envelope(k: Knowledge) -> DataFrame:
    return envelope.envelope("unified_explanation", explain(k))


def plan_envelope(k: Knowledge) -> DataFrame:
    return envelope.envelope("plan", plan(k))


def impact_envelope(k: Knowledge) -> DataFrame:
    return envelope.envelope("impact", topic_impact(k))


def _split(kind: str, text: str) -> str:
    """Puts a twin's last SELECT, which begins outside all brackets, into the envelope's SQL."""
    bare = re.sub("'[^']*'", lambda m: " " * len(m[0]), text)
    depth = 0
    for i, c in enumerate(bare):
        depth += (c == "(") - (c == ")")
        if not depth and bare.startswith(") SELECT ", i):
            return envelope.envelope_sql(kind, text[i + 2 :], text[: i + 1])
    raise ValueError("no SELECT behind the WITH list")


QUERIES |= {name: (run, _split(kind, QUERIES[of][1])) for name, run, kind, of in (("explain_envelope", explain_envelope, "unified_explanation", "explain"), ("plan_envelope", plan_envelope, "plan", "plan"), ("impact_envelope", impact_envelope, "impact", "topic_impact"))}

STEPS = " UNION ALL ".join(f"SELECT 'steps', {n}, '{n}. {x}'" for n, x in enumerate(packages.FIRST_STEPS, 1))


@query(f"SELECT 'key_decisions' AS section, CAST(row_number() OVER (ORDER BY title, id) AS INT) AS position, title AS text FROM (SELECT title, id FROM dec ORDER BY title, id LIMIT 10) UNION ALL SELECT 'orientation', 1, kind || ': ' || n FROM (SELECT 'decisions' AS kind, count(*) AS n FROM dec UNION ALL SELECT 'intents', count(*) FROM intent UNION ALL SELECT 'facts', count(*) FROM fact UNION ALL SELECT 'events', count(*) FROM evt) UNION ALL {STEPS}", "dec", "intent", "fact", "evt")
def onboard(k: Knowledge) -> DataFrame:
    return packages.onboard(k.decisions, readers.memory_counts(k.decisions, k.intents, k.facts, k.events))


# contexts, sessions, workflows ---------------------------------------------------------------------------------------

OVERVIEW = "SELECT {n} AS sec, '{kind} Overview' AS section, 'context' AS source, kind AS entity_type, id, text AS label, CAST(NULL AS DOUBLE) AS score, 0.0 AS rnk FROM items"
SCORED = "SELECT {n} AS sec, '{name}' AS section, '{source}' AS source, {kind} AS entity_type, {id} AS id, CAST(NULL AS VARCHAR) AS label, score, -score AS rnk FROM {rows}"
PLACED = "SELECT {n}, 'Learning Path', 'learning', {kind}, {id}, {label}, {score}, position FROM ({rows})"
PEOPLE_REPO = "SELECT contributor_id, CAST(4 * count(*) AS DOUBLE) AS score FROM exp GROUP BY 1"
PERSON_ID = f"'ctr_' || sha256('{REPO}:{PERSON}')"
FOUND = "SELECT entity_type, entity_id, max(score) AS score FROM ({hits}) GROUP BY 1, 2"
_STORAGE_HITS = "SELECT 'EXPERTISE' AS entity_type, id AS entity_id, CASE WHEN lower(domain) = 'storage' THEN 100 WHEN starts_with(lower(domain), 'storage') THEN 75 ELSE 50 END AS score FROM expid WHERE contains(lower(domain), 'storage')"


def _overview(k: Knowledge) -> DataFrame:
    return packages.items(_items(k), "kind", "id", "text")


def _path(found: DataFrame) -> DataFrame:
    """A learning path in its order; the places in the package number it."""
    return packages.items(rank.learning_rows(found), "entity_type", "entity_id", None, "score", F.col("bucket"), -F.col("score"))


def _reviewers(rows: DataFrame) -> DataFrame:
    return packages.items(rows, "CONTRIBUTOR", "contributor_id", None, "score")


def _repository_context(k: Knowledge, found: DataFrame | None = None) -> DataFrame:
    """found: discovery, stored, where the caller has it."""
    found = cut(_discovery(k)) if found is None else found
    return packages.context("repository", [_overview(k), packages.items(found, "entity_type", "entity_id", None, "score"), _path(found), _reviewers(cut(reviewers_repo(k)))])


def _domain_context(k: Knowledge) -> DataFrame:
    return packages.context("domain", [_overview(k), _path(_domain_discovery(k)), _reviewers(cut(reviewers_domain(k)))])


def _contributor_context(k: Knowledge) -> DataFrame:
    kinds = snapshot.leading_to("CONTRIBUTOR")  # no way to a person holds an edge to another type: words' pairs are not made
    nodes, edges = _nodes(k).where(F.col("node_type").isin(*kinds)), snapshot.edges(REPO, *_memories(k), towards=kinds)
    me = k.spark.range(1).select(_person()).first()[0]
    start = nodes.where((F.col("node_type") == "CONTRIBUTOR") & (F.col("entity_id") == me)).select("id")
    changes = graph.contributor_plan(edges.select(F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id")), nodes, start)
    path = packages.items(learning_contributor(k), "kind", "id", None, None, F.col("position"))
    return packages.context("contributor", [_overview(k), path, packages.items(changes, "entity_type", "entity_id", None, "priority", F.col("priority"))])


def _search(k: Knowledge, text: str) -> DataFrame:
    """All hits of a search."""
    return packages.items(search.federated(_tables(k), lambda: k.index, search.parse_query(text)), "entity_type", "entity_id", None, "score")


def _ordered(rows: str, *parts: str) -> str:
    """SQL: a package's rows with their place; parts: more columns of rows to keep."""
    kept = ", ".join([*parts, "section", "source", "entity_type", "id", "label", "score"])
    order = ", ".join([*(["artifact"] if "artifact" in parts else []), "sec", "rnk", "entity_type", "id", "label"])
    return f" SELECT {kept}, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS position FROM ({rows})"


_CONTEXT_SQL = {
    "repository": f"{OVERVIEW.format(n=1, kind='Repository')} UNION ALL {SCORED.format(n=2, name='Discovery', source='discovery', kind='entity_type', id='entity_id', rows='disc')} UNION ALL {PLACED.format(n=3, kind='entity_type', id='entity_id', label='NULL', score='score', rows=LEARN)} UNION ALL {SCORED.format(n=4, name='Reviewer Recommendations', source='reviewers', kind=repr('CONTRIBUTOR'), id='contributor_id', rows=f'({PEOPLE_REPO})')}",
    "domain": f"{OVERVIEW.format(n=1, kind='Domain')} UNION ALL {PLACED.format(n=2, kind='entity_type', id='entity_id', label='NULL', score='score', rows=LEARN + LEARN_DOMAIN)} UNION ALL {SCORED.format(n=3, name='Reviewer Recommendations', source='reviewers', kind=repr('CONTRIBUTOR'), id='contributor_id', rows='domain_people')}",
    "contributor": f"{OVERVIEW.format(n=1, kind='Contributor')} UNION ALL {PLACED.format(n=2, kind='kind', id='id', label='NULL', score='NULL', rows=LEARN_CONTRIBUTOR)} UNION ALL SELECT 3, 'Change Plan', 'changeplan', 'CONTRIBUTOR', contributor_id, NULL, 1.0, 1.0 FROM (SELECT DISTINCT contributor_id FROM expid WHERE contributor_id = {PERSON_ID})",
}
_PACKAGE_PARTS = _with("disc", "intent", "docs", "ctr", "expid", "dec_words", "evt_words", "fact_words", "stored") + f", {ITEMS}, {STORED}, domain_items AS ({DOMAIN_ITEMS}), domain_own AS (SELECT contributor_id, sum(score) AS e FROM exp WHERE domain = 'Storage' GROUP BY 1), domain_people AS (SELECT contributor_id, round(coalesce(e, 0) + coalesce(items, 0), 6) AS score FROM domain_own FULL JOIN domain_items USING (contributor_id) WHERE coalesce(e, 0) + coalesce(items, 0) > 0)"


def _found_sql(terms: list[str]) -> str:
    return f"found AS (SELECT entity_type, entity_id, max(score) AS score FROM (SELECT entity_type, id AS entity_id, CASE WHEN p = 1 AND rank < -10 THEN 100 WHEN p <= 3 THEN 75 ELSE 50 END AS score FROM (SELECT *, row_number() OVER (ORDER BY rank, id) AS p FROM hits) UNION ALL {_hits_sql(terms)}) GROUP BY 1, 2)"


def _hits_sql(terms: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT entity_type, entity_id, score FROM ({_match_sql(x, kind, terms)})" for x, kind in (("dec", "DECISION"), ("fact", "FACT"), ("evt", "EVENT"), ("intent", "INTENT"), ("ctr", "CONTRIBUTOR"), ("expid", "EXPERTISE")))


def _artifact(n: int, name: str, rows: str) -> str:
    return f"SELECT {n} AS artifact, '{name}' AS artifact_type, * FROM ({rows})"


def _single(kind: str, entity: str, key: str, rows: str, by: str = "-score", score: str = "score") -> str:
    return f"SELECT 1 AS sec, '' AS section, '{packages.SOURCES[kind]}' AS source, {entity} AS entity_type, {key} AS id, CAST(NULL AS VARCHAR) AS label, CAST({score} AS DOUBLE) AS score, CAST({by} AS DOUBLE) AS rnk FROM {rows}"


def _package_sql(prefix: str, kind: str, identifier: str, *artifacts: str) -> str:
    head = f"SELECT '{packages.package_id(prefix, REPO, kind, identifier)}' AS package_id, '{kind}' AS package_type, * FROM ("
    return _ordered(head + " UNION ALL ".join(artifacts) + ")", "package_id", "package_type", "artifact", "artifact_type")


SEARCHED = "login sqlite"
SEARCH_SQL = _single("search_result", "entity_type", "entity_id", "found")
SESSION_SQL = _CONTEXT_SQL["repository"]


def agent_context(k: Knowledge) -> DataFrame:
    """What to know of a repository: all rows of its four sections."""
    return packages.delivered(_repository_context(k), stored=True)


def context_domain(k: Knowledge) -> DataFrame:
    return packages.delivered(_domain_context(k), stored=True)


def context_contributor(k: Knowledge) -> DataFrame:
    return packages.delivered(_contributor_context(k))


def session_domain(k: Knowledge) -> DataFrame:
    return packages.delivered(packages.session("domain", REPO, "Storage", _domain_context(k), _search(k, "domain:Storage")))


def session_contributor(k: Knowledge) -> DataFrame:
    """A session about a person; the search is for the person's e-mail."""
    return packages.delivered(packages.session("contributor", REPO, PERSON, _contributor_context(k), _search(k, PERSON)))


def _session(k: Knowledge, context: DataFrame) -> DataFrame:
    return packages.session("repository", REPO, "", context).drop("package_id", "package_type", "artifact", "artifact_type")


def workflow_onboarding(k: Knowledge) -> DataFrame:
    found = cut(_discovery(k))
    parts = {"session": _session(k, _repository_context(k, found)), "discovery_report": packages.items(found, "entity_type", "entity_id", None, "score"), "learning_path": _path(found)}
    return packages.delivered(packages.workflow("onboarding", REPO, "", parts), stored=True)


def workflow_review(k: Knowledge) -> DataFrame:
    """Before a review: the repository's session, reviewers (of the domain where the query names one), hits and context."""
    context = _repository_context(k)
    asked = search.parse_query(SEARCHED)
    people = _reviewers(reviewers_domain(k) if asked.domain else reviewers_repo(k))
    return packages.delivered(packages.workflow("review_preparation", REPO, SEARCHED, {"session": _session(k, context), "reviewer_report": people, "search_result": _search(k, SEARCHED), "context_package": context}))


def workflow_change(k: Knowledge) -> DataFrame:
    """Before a decision changes: the repository's session, what the change touches, hits of the decision's id and context."""
    context = _repository_context(k)
    wanted = k.spark.range(1).select(t.sha_key("decision_", F.lit("adr12"))).first()[0]
    nodes, edges = _graph(k)
    start = cut(nodes.where((F.col("node_type") == "DECISION") & (F.col("entity_id") == wanted)).select("id"))
    reached = graph.reach(edges.select(F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id")), start).where("hops > 0")
    kinds = nodes.where("node_type IN ('DECISION', 'FACT', 'EVENT', 'CONTRIBUTOR')")
    changes = reached.join(kinds, "id").select("node_type", "entity_id", F.least("hops", F.lit(3)).alias("priority"))
    parts = {"session": _session(k, context), "change_plan": packages.items(changes, "node_type", "entity_id", None, "priority", F.col("priority")), "search_result": _search(k, wanted), "context_package": context}
    return packages.delivered(packages.workflow("change_preparation", REPO, "adr12", parts))


def workflow_exploration(k: Knowledge) -> DataFrame:
    return packages.delivered(packages.workflow("knowledge_exploration", REPO, SEARCHED, {"session": _session(k, _repository_context(k)), "search_result": _search(k, SEARCHED)}))


_SEARCH_PARTS = f", {_bm25_sql(SEARCHED.split())}, {_found_sql(SEARCHED.split())}"
_REPORT = _single("reviewer_report", "'CONTRIBUTOR'", "contributor_id", f"({PEOPLE_REPO})")
QUERIES |= {
    "agent_context": (agent_context, _PACKAGE_PARTS + _ordered(_CONTEXT_SQL["repository"])),
    "context_domain": (context_domain, _PACKAGE_PARTS + _ordered(_CONTEXT_SQL["domain"])),
    "context_contributor": (context_contributor, _PACKAGE_PARTS + _ordered(_CONTEXT_SQL["contributor"])),
    "session_domain": (session_domain, _PACKAGE_PARTS + _package_sql("ses", "domain", "Storage", _artifact(1, "context_package", _CONTEXT_SQL["domain"]), _artifact(2, "search_result", _single("search_result", "entity_type", "entity_id", f"({_STORAGE_HITS})")))),
    "session_contributor": (session_contributor, None),
    "workflow_onboarding": (workflow_onboarding, _PACKAGE_PARTS + _package_sql("wrk", "onboarding", "default", _artifact(1, "session", SESSION_SQL), _artifact(2, "discovery_report", _single("discovery_report", "entity_type", "entity_id", "disc")), _artifact(3, "learning_path", _single("learning_path", "entity_type", "entity_id", f"({LEARN})", "position")))),
    "workflow_review": (workflow_review, _PACKAGE_PARTS + _SEARCH_PARTS + _package_sql("wrk", "review_preparation", SEARCHED, _artifact(1, "session", SESSION_SQL), _artifact(2, "reviewer_report", _REPORT), _artifact(3, "search_result", SEARCH_SQL), _artifact(4, "context_package", SESSION_SQL))),
    "workflow_change": (workflow_change, None),
    "workflow_exploration": (workflow_exploration, _PACKAGE_PARTS + _SEARCH_PARTS + _package_sql("wrk", "knowledge_exploration", SEARCHED, _artifact(1, "session", SESSION_SQL), _artifact(2, "search_result", SEARCH_SQL))),
}


def session_memory(k: Knowledge) -> DataFrame:
    """Answers of conversations as remembered facts: one per question that an assistant answers."""
    turns = k.table("conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("question"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.trim("text").alias("answer"))
    return workspace.remembered_rows(asked.join(said, ["conv_id", "turn"]).select(F.col("question").alias("subject"), F.concat("question", F.lit(" => "), "answer").alias("content")), REPO)


QUERIES["session_memory"] = (
    session_memory,
    f"SELECT DISTINCT 'fact_' || sha256('{workspace.session_source(REPO)}' || subject || '{workspace.REMEMBERED}' || content) AS id, '{REPO}' AS repository_id, '{workspace.session_source(REPO)}' AS source_id, subject, '{workspace.REMEMBERED}' AS predicate, content AS object FROM (SELECT trim(q.text) AS subject, trim(q.text) || ' => ' || trim(a.text) AS content FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant') WHERE subject <> ''",
)
