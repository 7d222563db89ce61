"""Registered readers, traces, graph views and topic answers, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import PERSON, QUERIES, TREE, _bm25_sql, _match_sql, _tables, query
from .functions import text as t
from .operators import answers, code, graph, ownership, readers, search, snapshot, topics, traces
from .plans.knowledge import Knowledge
from .plans.oracle import sql
from .sources.adapters import REPO

DECISION = "sha256('adr12')"  # the id that follows decision_
START = "'decision_' || sha256('adr12')"
TASK = "m12 fn12"


def _with(*needs: str) -> str:
    """The WITH list of some parts, to which more can be added."""
    return sql("SELECT 1", *needs).removesuffix(" SELECT 1")


# readers ------------------------------------------------------------------------------------------------------------


@query(f"SELECT id, title, status, source_id FROM dec WHERE id = {START}", "dec")
def get_decision(k: Knowledge) -> DataFrame:
    wanted = k.spark.range(1).select(t.sha_key("decision_", F.lit("adr12"))).first()[0]
    return readers.by_id(k.decisions, wanted).select("id", "title", "status", "source_id")


@query("SELECT id, event_type, title FROM evt ORDER BY id", "evt")
def list_events(k: Knowledge) -> DataFrame:
    return readers.of_repository(k.events, REPO, "id").select("id", "event_type", "title")


@query("SELECT id, subject, predicate, object FROM fact ORDER BY id", "fact")
def list_facts(k: Knowledge) -> DataFrame:
    return readers.of_repository(k.facts, REPO, "id").select("id", "subject", "predicate", "object")


@query("SELECT id, description, source_id FROM intent ORDER BY id", "intent")
def list_intents(k: Knowledge) -> DataFrame:
    return readers.of_repository(k.intents, REPO, "id").select("id", "description", "source_id")


@query("SELECT id, entity_type, qualified_name FROM entities WHERE package_path = 'pkg/Brand#12' AND entity_type = 'struct' ORDER BY qualified_name", "entities")
def entities_of_package(k: Knowledge) -> DataFrame:
    return readers.find(k.entities, "entities", package_path="pkg/Brand#12", entity_type="struct").select("id", "entity_type", "qualified_name")


@query("SELECT from_id, to_id, relationship_type FROM calls WHERE to_id = 'part:7'", "calls")
def callers_of(k: Knowledge) -> DataFrame:
    return readers.find(k.relations, "relations", to_id="part:7")


@query(f"SELECT domain, score FROM exp WHERE contributor_id = 'ctr_' || sha256('{REPO}:{PERSON}')", "exp")
def expertise_of(k: Knowledge) -> DataFrame:
    wanted = k.spark.range(1).select(t.sha_key("ctr_", F.lit(REPO), F.lit(PERSON))).first()[0]
    return readers.find(k.expertise, "expertise", contributor_id=wanted).select("domain", "score")


@query("SELECT e.contributor_id, domain, score, coalesce(name, '') AS name, coalesce(email, '') AS email FROM exp e LEFT JOIN ctr ON ctr.id = e.contributor_id", "exp", "ctr")
def expertise_owners(k: Knowledge) -> DataFrame:
    return readers.with_owner(k.expertise, k.contributors).select("contributor_id", "domain", "score", "name", "email")


@query("SELECT 'decisions' AS kind, count(*) AS n FROM dec UNION ALL SELECT 'intents', count(*) FROM intent UNION ALL SELECT 'facts', count(*) FROM fact UNION ALL SELECT 'events', count(*) FROM evt", "dec", "intent", "fact", "evt")
def memory_counts(k: Knowledge) -> DataFrame:
    return readers.memory_counts(k.decisions, k.intents, k.facts, k.events)


@query("SELECT CASE suffix WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' ELSE '' END AS language FROM (SELECT regexp_extract(file_path, '(\\.[^./]*)$', 1) AS suffix, count(*) AS n FROM entities GROUP BY 1 ORDER BY n DESC, suffix LIMIT 1)", "entities")
def dominant_language(k: Knowledge) -> DataFrame:
    return readers.dominant_language(k.entities.select(F.col("file_path").alias("path")))


@query("SELECT DISTINCT file_path AS path, package_path AS module FROM entities e JOIN part ON p_partkey = CAST(substr(e.id, 6) AS BIGINT) WHERE p_size % 3 = 0 OR p_size % 5 = 0 OR p_retailprice < 1000", "entities")
def changed_modules(k: Knowledge) -> DataFrame:
    part = k.table("part").selectExpr("'part:' || CAST(p_partkey AS STRING) AS id", "p_size", "p_retailprice")
    rows = k.entities.join(part, "id").select(F.col("file_path").alias("path"), "p_size", "p_retailprice")
    return readers.changed_modules([rows.where("p_size % 3 = 0"), rows.where("p_size % 5 = 0"), rows.where("p_retailprice < 1000")], k.entities.select(F.col("package_path").alias("folder")))


@query("SELECT source, kind, count(*) AS n FROM (SELECT 'memory' AS source, 'DECISION' AS kind FROM dec UNION ALL SELECT 'memory', 'FACT' FROM fact UNION ALL SELECT 'ownership', 'EXPERTISE' FROM exp) GROUP BY 1, 2", "dec", "fact", "exp")
def evidence_counts(k: Knowledge) -> DataFrame:
    tag = lambda rows, source, kind: rows.select(F.lit(source).alias("source"), F.lit(kind).alias("kind"))
    return readers.evidence_counts(tag(k.decisions, "memory", "DECISION").unionByName(tag(k.facts, "memory", "FACT")).unionByName(tag(k.expertise, "ownership", "EXPERTISE")))


# traces -------------------------------------------------------------------------------------------------------------


def _decision_ids(k: Knowledge) -> DataFrame:
    """The decisions of records whose number ends in 2."""
    return k.decisions.where("source_id LIKE '%2'").select("id")


ASKED = "asked AS (SELECT id FROM dec WHERE source_id LIKE '%2')"


def trace_decision_rows(k: Knowledge) -> DataFrame:
    return traces.trace_decisions(_decision_ids(k), k.intents, k.decisions, k.events, k.facts)


QUERIES["trace_decision_rows"] = (
    trace_decision_rows,
    _with("stored", "labels_of") + f", {ASKED} SELECT DISTINCT a.id AS start_id, l.kind, l.id AS entity_id, label FROM asked a JOIN stored s ON (s.to_id = a.id AND s.kind <> 'DECISION_RESULTS_IN_EVENT') OR (s.from_id = a.id AND s.kind = 'DECISION_RESULTS_IN_EVENT') JOIN labels_of l ON l.id = CASE WHEN s.to_id = a.id THEN s.from_id ELSE s.to_id END",
)

EVENTS = "hit AS (SELECT id FROM evt WHERE source_id LIKE '%6')"
BEHIND = "one AS (SELECT h.id AS start_id, from_id AS x FROM hit h JOIN stored ON to_id = h.id AND kind = 'DECISION_RESULTS_IN_EVENT'), two AS (SELECT start_id, from_id AS x FROM one JOIN stored ON to_id = x AND kind = 'INTENT_DRIVES_DECISION'), rows AS (SELECT DISTINCT start_id, l.kind, l.id AS entity_id, label FROM (FROM one UNION ALL FROM two) JOIN labels_of l ON l.id = x)"


def _event_trace(k: Knowledge) -> DataFrame:
    return traces.trace_events(k.events.where("source_id LIKE '%6'").select("id"), k.intents, k.decisions, k.events)


def trace_event_rows(k: Knowledge) -> DataFrame:
    return _event_trace(k)


QUERIES["trace_event_rows"] = (trace_event_rows, _with("stored", "labels_of") + f", {EVENTS}, {BEHIND} FROM rows")


def event_guidance(k: Knowledge) -> DataFrame:
    return traces.reasons(_event_trace(k), True)


QUERIES["event_guidance"] = (
    event_guidance,
    _with("stored", "labels_of") + f", {EVENTS}, {BEHIND} SELECT start_id, CAST(row_number() OVER (PARTITION BY start_id ORDER BY kind, entity_id) AS INT) AS position, CASE kind WHEN 'DECISION' THEN 'Caused by decision: ' ELSE 'Driven by intent: ' END || label AS reason FROM rows",
)


@query(f"SELECT d.id AS start_id, CAST(row_number() OVER (PARTITION BY d.id ORDER BY i.id) AS INT) AS position, description AS reason FROM dec d JOIN intent i USING (source_id) WHERE source_id LIKE '%2'", "dec", "intent")
def decision_guidance(k: Knowledge) -> DataFrame:
    return traces.reasons(traces.trace_decisions(_decision_ids(k), k.intents, k.decisions, k.events, k.facts), False)


AFTER = "one AS (SELECT h.id AS start_id, to_id AS x FROM hit h JOIN stored ON from_id = h.id AND kind = '{kind}'), two AS (SELECT start_id, to_id AS x FROM one JOIN stored ON from_id = x AND kind = 'DECISION_RESULTS_IN_EVENT') SELECT DISTINCT start_id, l.kind, l.id AS entity_id, label FROM (FROM one UNION ALL FROM two) JOIN labels_of l ON l.id = x"


def intent_impact(k: Knowledge) -> DataFrame:
    return traces.intent_impact(k.intents.where("source_id LIKE 'adr%2'").select("id"), k.intents, k.decisions, k.events)


def fact_impact(k: Knowledge) -> DataFrame:
    return traces.fact_impact(k.facts.where("predicate = 'CALLS'").select("id"), k.facts, k.decisions, k.events)


QUERIES |= {
    "intent_impact": (intent_impact, _with("stored", "labels_of") + ", hit AS (SELECT id FROM intent WHERE source_id LIKE 'adr%2'), " + AFTER.format(kind="INTENT_DRIVES_DECISION")),
    "fact_impact": (fact_impact, _with("stored", "labels_of") + ", hit AS (SELECT id FROM fact WHERE predicate = 'CALLS'), " + AFTER.format(kind="FACT_SUPPORTS_DECISION")),
}

# the knowledge graph ------------------------------------------------------------------------------------------------


def _memories(k: Knowledge) -> tuple[DataFrame, ...]:
    return k.decisions, k.facts, k.events, k.intents, k.contributors, k.expertise_rows


def _nodes(k: Knowledge) -> DataFrame:
    """The graph's nodes alone, which need no edge."""
    return snapshot.nodes(REPO, *_memories(k))


def _graph(k: Knowledge) -> tuple[DataFrame, DataFrame]:
    return _nodes(k), k._once("graph-edges", lambda: snapshot.edges(REPO, *_memories(k)))


@query("SELECT id, from_node_id, to_node_id, edge_type, category FROM kgraph", "kgraph")
def knowledge_graph(k: Knowledge) -> DataFrame:
    return _graph(k)[1].drop("evidence")


@query("SELECT id, node_type, entity_id FROM knodes", "knodes")
def knowledge_nodes(k: Knowledge) -> DataFrame:
    return _nodes(k).select("id", "node_type", "entity_id")


@query("SELECT id, node_type, entity_id, degree FROM ktop", "ktop")
def graph_top(k: Knowledge) -> DataFrame:
    return snapshot.top_nodes(*_graph(k))


@query("SELECT id, edge_type FROM kgraph WHERE from_node_id IN (SELECT id FROM ktop) AND to_node_id IN (SELECT id FROM ktop)", "ktop")
def graph_top_edges(k: Knowledge) -> DataFrame:
    nodes, edges = _graph(k)
    return snapshot.induced(snapshot.top_nodes(nodes, edges), edges).select("id", "edge_type")


NODE = f"'nod_' || sha256('{REPO}:DECISION:decision_' || {DECISION})"


@query(f"SELECT 'in' AS direction, id, from_node_id AS other, edge_type, category FROM kgraph WHERE to_node_id = {NODE} UNION ALL SELECT 'out', id, to_node_id, edge_type, category FROM kgraph WHERE from_node_id = {NODE}", "kgraph")
def node_detail(k: Knowledge) -> DataFrame:
    wanted = k.spark.range(1).select(snapshot.node_id(F.lit(REPO), "DECISION", t.sha_key("decision_", F.lit("adr12")))).first()[0]
    return snapshot.node_detail(_graph(k)[1], wanted)


@query("SELECT id, node_type FROM knodes WHERE node_type = 'FACT' AND contains(lower(id || ' ' || node_type || ' ' || entity_id), 'ab1')", "knodes")
def filter_nodes(k: Knowledge) -> DataFrame:
    return snapshot.filter_nodes(_nodes(k), "fact", "AB1").select("id", "node_type")


def suggest_questions(k: Knowledge) -> DataFrame:
    return snapshot.suggested_questions(None, _graph(k)[1])


QUERIES["suggest_questions"] = (
    suggest_questions,
    _with("kdegree", "knodes") + ", hub AS (SELECT id FROM kdegree WHERE degree >= 2 ORDER BY degree DESC, id LIMIT 1), sur AS (SELECT from_node_id, to_node_id FROM kgraph JOIN knodes a ON a.id = from_node_id JOIN knodes b ON b.id = to_node_id WHERE a.node_type <> b.node_type ORDER BY 1, 2 LIMIT 1) SELECT 1 AS position, 'Why is ' || id || ' a hub in the knowledge graph?' AS question FROM hub UNION ALL SELECT 2, 'What links ' || from_node_id || ' and ' || to_node_id || ' across communities?' FROM sur",
)


@query("SELECT from_node_id, count(*) AS n FROM kgraph WHERE category = 'DERIVED' GROUP BY 1", "kgraph")
def derived_degrees(k: Knowledge) -> DataFrame:
    """From the derived edges alone: the stored ones, pairs by words among them, are not made."""
    return snapshot.edges(REPO, *_memories(k), stored=False).groupBy("from_node_id").agg(F.count(F.lit(1)).alias("n"))


def community_ids(k: Knowledge) -> DataFrame:
    """Components of the business graph with their hashed ids, the largest first."""
    return graph.with_component_ids(graph.components(k.edges), REPO).orderBy(F.desc("size"), "component_id")


QUERIES["community_ids"] = (
    community_ids,
    _with("edges") + TREE.replace(" SELECT id, min(id) OVER (PARTITION BY root) AS component FROM whole", "") + f" SELECT 'com_' || substr(sha256('{REPO}' || string_agg(chr(0) || id, '' ORDER BY id)), 1, 16) AS component_id, count(*) AS size FROM whole GROUP BY root",
)

# topics -------------------------------------------------------------------------------------------------------------

TERMS = TASK.split()
_topic_hits = " UNION ALL ".join(_match_sql(x, kind, TERMS) for x, kind in (("dec", "DECISION"), ("fact", "FACT"), ("evt", "EVENT"), ("intent", "INTENT"), ("ctr", "CONTRIBUTOR"), ("expid", "EXPERTISE")))
_code_score = " + ".join(f"CASE WHEN lower(name) = '{w}' OR lower(qualified_name) = '{w}' THEN 100 WHEN lower(qualified_name) LIKE '%.{w}' THEN 80 WHEN contains(lower(name), '{w}') THEN 50 WHEN contains(lower(qualified_name), '{w}') THEN 40 WHEN contains(lower(file_path), '{w}') THEN 25 ELSE 0 END" for w in TERMS)
TOPIC = (
    _with("docs", "intent", "ctr", "expid", "bridge")
    + f", {_bm25_sql(TERMS)}, mem AS (SELECT DISTINCT entity_id AS id FROM (SELECT id AS entity_id FROM hits UNION ALL SELECT entity_id FROM ({_topic_hits}))), cod AS (SELECT id FROM (SELECT *, {_code_score} AS score FROM entities) WHERE score > 0 ORDER BY score DESC, entity_type, qualified_name, id LIMIT 20),"
    # each memory has one link and each entity one, so a link adds no further link
    " lnk AS (SELECT * FROM bridge WHERE memory_id IN (SELECT id FROM mem) OR code_id IN (SELECT id FROM cod)),"
    " topic AS (SELECT 'repository' AS side, id FROM mem UNION SELECT 'repository', memory_id FROM lnk UNION SELECT 'code', id FROM cod UNION SELECT 'code', code_id FROM lnk)"
)


def _topic(k: Knowledge) -> DataFrame:
    hits = search.federated(_tables(k), lambda: k.index, search.parse_query(TASK))
    return topics.resolve_topic(TASK, hits, k.entities, k.bridge)


def topic_resolution(k: Knowledge) -> DataFrame:
    return _topic(k)


def topic_class(k: Knowledge) -> DataFrame:
    return topics.topic_class(_topic(k))


def _known(k: Knowledge, resolved: DataFrame) -> DataFrame:
    return readers.resolve(resolved.where("side = 'repository'").select("id"), k.decisions, k.facts, k.events, k.expertise_rows)


def topic_entities(k: Knowledge) -> DataFrame:
    return _known(k, _topic(k))


def reuse_check(k: Knowledge) -> DataFrame:
    found = topics.cut(_topic(k))
    code_rows = topics.with_siblings(found.where("side = 'code'").select("id"), k.entities)
    decisions = _known(k, found).where("entity_type = 'DECISION'").select(F.col("entity_id").alias("id"), F.col("label").alias("title"))
    return topics.reuse_candidates(code_rows, decisions)


def review(k: Knowledge) -> DataFrame:
    found = topics.cut(_topic(k))
    return topics.review_guide(found, k.entities, _known(k, found), topics.match_expertise(k.expertise_rows, "storage agent"))


KNOWN = ", known AS (SELECT id AS entity_id, kind AS entity_type, label FROM (SELECT id, 'DECISION' AS kind, title AS label FROM dec UNION ALL SELECT id, 'FACT', subject || ' ' || predicate || ' ' || object FROM fact UNION ALL SELECT id, 'EVENT', title FROM evt UNION ALL SELECT id, 'EXPERTISE', domain FROM expid) WHERE id IN (SELECT id FROM topic WHERE side = 'repository'))"
QUERIES |= {
    "topic_resolution": (topic_resolution, TOPIC + " SELECT side, id FROM topic"),
    "topic_class": (topic_class, TOPIC + ", n AS (SELECT count(*) FILTER (side = 'repository') AS r, count(*) FILTER (side = 'code') AS c FROM topic) SELECT CASE WHEN r > 0 AND c > 0 THEN 'mixed' WHEN c > 0 THEN 'code' WHEN r > 0 THEN 'repository' ELSE 'none' END AS primary_type, r AS repository_hits, c AS code_hits FROM n"),
    "topic_entities": (topic_entities, TOPIC + KNOWN + " FROM known"),
    "reuse_check": (
        reuse_check,
        TOPIC + KNOWN + " SELECT CASE entity_type WHEN 'function' THEN 1 WHEN 'method' THEN 1 ELSE 2 END AS rank, entity_type, qualified_name AS label, file_path AS defined_in, entity_type || ' ' || name || ' — ' || split_part(package_path, '/', 2) || ' (public API surface)' AS role FROM entities WHERE id IN (SELECT id FROM topic WHERE side = 'code') UNION ALL SELECT 10, 'DECISION', label, entity_id, 'existing decision pattern' FROM known WHERE entity_type = 'DECISION'",
    ),
    "review": (
        review,
        TOPIC + KNOWN + ", need AS (SELECT entity_type, entity_id AS id, label FROM known WHERE entity_type = 'EXPERTISE' UNION SELECT 'EXPERTISE', id, domain FROM expid WHERE contains(lower(domain), 'storage') OR contains(lower(domain), 'agent')) SELECT 'related_knowledge' AS section, entity_type, entity_id AS id, label FROM known WHERE entity_type <> 'EXPERTISE' UNION ALL SELECT 'required_expertise', * FROM need UNION ALL SELECT 'affected_areas', entity_type, entity_id, label FROM known WHERE entity_type = 'EXPERTISE'",
    ),
}


@query("SELECT 'EXPERTISE' AS kind, id, domain AS label, score FROM expid WHERE contains(lower(domain), 'storage') OR contains(lower(domain), 'agent') UNION ALL SELECT 'CONTRIBUTOR', contributor_id, contributor_id, max(score) FROM expid WHERE contains(lower(domain), 'storage') OR contains(lower(domain), 'agent') GROUP BY contributor_id", "expid")
def expertise_match(k: Knowledge) -> DataFrame:
    return topics.match_expertise(k.expertise_rows, "storage agent")


@query("SELECT 'Primary owner candidates for \"storage\":' || chr(10) || string_agg('  - ' || contributor_id, chr(10) ORDER BY score DESC, contributor_id) AS summary FROM (SELECT contributor_id, score FROM exp WHERE domain = 'Storage' ORDER BY score DESC, contributor_id LIMIT 3)", "exp")
def ask_ownership(k: Knowledge) -> DataFrame:
    return topics.ownership_answer(k.expertise, answers.route("who owns storage?").subject)


@query("SELECT entity_type, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY qualified_name, id) AS INT) AS position, id, qualified_name, count(*) OVER (PARTITION BY entity_type) AS n FROM entities WHERE file_path = (SELECT min(file_path) FROM entities)", "entities")
def file_context(k: Knowledge) -> DataFrame:
    path = k.entities.agg(F.min("file_path")).first()[0]
    return topics.file_context(k.entities, path)


@query("SELECT name, n, candidates FROM (SELECT lower(p_type) AS name, count(*) AS n, array_to_string(list_sort(list_distinct(list('pkg/' || p_brand || '.Fn' || p_partkey)))[1:5], ',') AS candidates FROM part GROUP BY 1) WHERE n > 1")
def ambiguous_names(k: Knowledge) -> DataFrame:
    named = k.table("part").selectExpr("'part:' || CAST(p_partkey AS STRING) AS id", "p_type AS name", "'pkg/' || p_brand || '.Fn' || CAST(p_partkey AS STRING) AS qualified_name")
    return topics.ambiguous_names(named)


@query("SELECT DISTINCT e.id, e.qualified_name FROM entities e WHERE file_path IN (SELECT file_path FROM entities WHERE id = 'part:3' OR id = 'part:5')", "entities")
def file_siblings(k: Knowledge) -> DataFrame:
    """Parts 3 and 5 stand for their files."""
    files = k.entities.withColumn("entity_type", F.when(F.col("id").isin("part:3", "part:5"), "file").otherwise(F.col("entity_type")))
    return topics.with_siblings(k.entities.where("id IN ('part:3', 'part:5')").select("id"), files).select("id", "qualified_name")


@query("SELECT CAST(row_number() OVER (ORDER BY title, id) AS INT) AS position, id, title FROM dec ORDER BY title, id LIMIT 10", "dec")
def onboarding(k: Knowledge) -> DataFrame:
    return topics.onboarding(k.decisions)


@query("SELECT contributor_id, domain, score, sources FROM exp JOIN (SELECT contributor_id, count(*) AS sources FROM who WHERE source_type = 'commit' GROUP BY 1) USING (contributor_id) WHERE domain = 'Agent Intelligence' AND score >= 0.5", "exp", "who")
def domain_owners(k: Knowledge) -> DataFrame:
    counts = ownership.with_contributor(k.commits).groupBy("contributor_id").agg(F.count(F.lit(1)).alias("sources"))
    return k.expertise.where("domain = 'Agent Intelligence' AND score >= 0.5").select("contributor_id", "domain", "score").join(counts, "contributor_id")


@query("SELECT id, entity_type || ' ' || name || ' — ' || split_part(package_path, '/', 2) || ' (public API surface)' AS role FROM entities", "entities")
def entity_roles(k: Knowledge) -> DataFrame:
    return k.entities.select("id", code.entity_role(F.col("entity_type"), F.col("name"), F.col("package_path")).alias("role"))
