"""SQL (DuckDB's dialect) for the same tables, as parts that the queries' twins are put together from."""

from __future__ import annotations

from ..constants import COMMIT_EVENTS, DOMAIN_KEYWORDS, INTENT_WORDS, STOP_WORDS
from ..sources.adapters import COMMITS, RECORDS, select_list
from .knowledge import EDGES, ENTITY, NODES


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _title(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_split_to_array({_strip(x)}, '\s+'), lambda w: upper(w[1]) || w[2:]), ' ')"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _domains(x: str) -> str:
    tests = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower({x}), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{d}' END" for d, words in DOMAIN_KEYWORDS.items())
    return f"list_filter([{tests}], lambda z: z IS NOT NULL)"


def _words(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({_list(STOP_WORDS)}, w)))"


def _clean_fact(x: str) -> str:
    x = _strip(rf"regexp_replace({x}, '^(?:#+\s*)+', '')")
    return _strip(rf"regexp_replace(regexp_replace({x}, '^(?:- )?(?:\* )?(?:\+ )?', ''), '[*_`]', '', 'g')")


def _clean_intent(x: str) -> str:
    x = _strip(rf"regexp_replace({x}, '^(?:#+\s*)+', '')")
    x = _strip(f"regexp_replace({x}, '^[-*+] ', '')")
    x = _strip(rf"regexp_replace({x}, '^[0-9]+\. ', '')")
    return _strip(f"regexp_replace({x}, '^[*_`]+|[*_`]+$', '', 'g')")


def _segments(x: str) -> str:
    flat = f"regexp_replace({x}, '[!?;,]', '.', 'g')"
    for w in ("and", "but", "also"):
        flat = f"regexp_replace({flat}, '(?i) (?:{w} )+', '. ', 'g')"
    strip = _strip("s")
    return rf"list_filter(list_transform(regexp_split_to_array({flat}, '[.\n]'), lambda s: {strip}), lambda s: s <> '')"


_event_case = "CASE lower(trim(regexp_extract(trim(split_part(title, ':', 1)), '^[^(]*'))) " + " ".join(f"WHEN '{w}' THEN '{e}'" for w, e in COMMIT_EVENTS.items()) + " END"
_verbs = (("STORES_IN", r"stores\s+data\s+in"), ("DEPENDS_ON", r"depends\s+on"), ("USES", "uses"), ("CALLS", "calls"))
_fact_case = lambda make: "CASE " + " ".join(f"WHEN regexp_matches(segment, '(?i)^(.+?)\\b{v}\\b(.+)') THEN {make(n, v)}" for n, v in _verbs) + " END"
_part = lambda k: _fact_case(lambda _, v: f"regexp_extract(segment, '(?i)^(.+?)\\b{v}\\b(.+)', {k})")
_phrase = _strip(f"regexp_extract(segment, '(?is)(?:{'|'.join(INTENT_WORDS)}).*$', 0)")

#: Each part: (name, the parts it needs, its SELECT).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "commits": ((), f"SELECT {select_list(COMMITS)} FROM events"),
    "records": ((), f"SELECT {select_list(RECORDS)} FROM documents"),
    "evt": (("commits",), f"SELECT 'evt_' || sha256('event:' || repository_id || ':' || id) AS id, id AS source_id, event_type, {_title('rest')} AS title, title AS description FROM (SELECT *, CASE WHEN contains(title, ':') THEN {_event_case} END AS event_type, substr(title, strpos(title, ':') + 1) AS rest FROM commits) WHERE event_type IS NOT NULL AND {_strip('rest')} <> ''"),
    "dec": (("records",), "SELECT 'decision_' || sha256(id) AS id, title, coalesce(nullif(status, ''), 'Proposed') AS status, id AS source_id, reference, content FROM records"),
    "fact_segments": (("records",), f"SELECT id AS source_id, unnest({_segments('content')}) AS segment FROM records WHERE source_type = 'adr'"),
    "fact": (("fact_segments",), f"SELECT DISTINCT 'fact_' || sha256(source_id || subject || predicate || object) AS id, source_id, subject, predicate, object FROM (SELECT source_id, {_title(_clean_fact(_part(1)))} AS subject, {_fact_case(lambda n, v: chr(39) + n + chr(39))} AS predicate, {_title(_clean_fact(_part(2)))} AS object FROM fact_segments) WHERE predicate IS NOT NULL AND subject <> '' AND object <> ''"),
    "intent_segments": (("records", "commits"), f"SELECT source_id, unnest({_segments('body')}) AS segment FROM (SELECT id AS source_id, content AS body FROM records WHERE source_type = 'adr' UNION ALL SELECT id, title FROM commits)"),
    "intent": (("intent_segments",), f"SELECT 'intent_' || sha256(source_id || ':' || lower(description)) AS id, source_id, min(description) AS description FROM (SELECT source_id, {_title('phrase')} AS description FROM (SELECT source_id, {_clean_intent(f'regexp_replace({_phrase}, {chr(39)}[.,;!?]+${chr(39)}, {chr(39)}{chr(39)})')} AS phrase FROM intent_segments) WHERE phrase <> '') GROUP BY ALL"),
    "who": (("commits", "records"), r"SELECT id AS source_id, source_type, ts, regexp_extract(author, '^([^<]+?)\s*<([^>]+)>$', 1) AS name, regexp_extract(author, '^([^<]+)\s*<([^>]+)>$', 2) AS email, 'ctr_' || sha256(repository_id || ':' || regexp_extract(author, '^([^<]+)\s*<([^>]+)>$', 2)) AS contributor_id FROM (SELECT id, source_type, ts, author, repository_id FROM commits UNION ALL SELECT id, source_type, ts, author, repository_id FROM records)"),
    "ctr": (("who",), "SELECT contributor_id AS id, email, min(name) AS name, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS commit_count FROM who WHERE source_type = 'commit' GROUP BY 1, 2"),
    "exp_rows": (("commits", "dec", "fact", "evt"), f"SELECT id AS source_id, 'commits' AS kind, unnest({_domains('title')}) AS domain FROM commits UNION ALL SELECT source_id, 'decisions', unnest({_domains('title')}) FROM dec UNION ALL SELECT source_id, 'facts', unnest({_domains('subject || chr(10) || predicate || chr(10) || object')}) FROM fact UNION ALL SELECT source_id, 'events', unnest({_domains('title || chr(10) || description')}) FROM evt"),
    "exp_raw": (("exp_rows", "who", "ctr"), "SELECT contributor_id, domain, count(*) FILTER (kind = 'commits') AS commits, count(*) FILTER (kind = 'decisions') AS decisions, count(*) FILTER (kind = 'facts') AS facts, count(*) FILTER (kind = 'events') AS events, max(ts) AS last FROM exp_rows JOIN who USING (source_id) WHERE contributor_id IN (SELECT id FROM ctr) GROUP BY 1, 2"),
    "exp": (("exp_raw",), "SELECT contributor_id, domain, round((commits * 1.0 + decisions * 5.0 + facts * 2.0 + events * 3.0) / max(commits * 1.0 + decisions * 5.0 + facts * 2.0 + events * 3.0) OVER (PARTITION BY domain), 6) AS score, commits, decisions, facts, events, coalesce((SELECT max(ts) FROM who WHERE source_type = 'commit') <= last + INTERVAL 30 DAY, false) AS recent FROM exp_raw"),
    "expid": (("exp",), "SELECT *, 'exp_' || sha256('repo_main:' || contributor_id || ':' || domain) AS id FROM exp"),
    "bridge": (("dec", "entities"), "SELECT 'DECISION_REFERENCES_CODE' AS relationship_type, d.id AS memory_id, e.id AS code_id FROM dec d JOIN entities e ON e.name = 'Fn' || substr(d.source_id, 4)"),
    "stored": (
        ("dec", "intent", "dec_words", "evt_words", "fact_words"),
        "SELECT i.id AS from_id, d.id AS to_id, 'INTENT_DRIVES_DECISION' AS kind FROM intent i JOIN dec d USING (source_id) UNION ALL SELECT DISTINCT d.id, e.id, 'DECISION_RESULTS_IN_EVENT' FROM dec_words d JOIN evt_words e USING (word) UNION ALL SELECT DISTINCT f.id, d.id, 'FACT_SUPPORTS_DECISION' FROM fact_words f JOIN dec_words d USING (word)",
    ),
    "labels_of": (("dec", "intent", "fact", "evt"), "SELECT id, 'DECISION' AS kind, title AS label FROM dec UNION ALL SELECT id, 'INTENT', description FROM intent UNION ALL SELECT id, 'FACT', subject || ' ' || predicate || ' ' || object FROM fact UNION ALL SELECT id, 'EVENT', title FROM evt"),
    "kgraph": (
        ("stored", "expid", "ctr", "dec", "fact"),
        "SELECT 'edg_' || sha256('repo_main:' || a || ':' || b || ':' || kind) AS id, a AS from_node_id, b AS to_node_id, kind AS edge_type, category FROM (SELECT 'nod_' || sha256('repo_main:' || ta || ':' || x) AS a, 'nod_' || sha256('repo_main:' || tb || ':' || y) AS b, kind, category FROM ("
        "SELECT CASE kind WHEN 'INTENT_DRIVES_DECISION' THEN 'INTENT' WHEN 'FACT_SUPPORTS_DECISION' THEN 'FACT' ELSE 'DECISION' END AS ta, from_id AS x, CASE kind WHEN 'DECISION_RESULTS_IN_EVENT' THEN 'EVENT' ELSE 'DECISION' END AS tb, to_id AS y, kind, 'STORED' AS category FROM stored "
        "UNION ALL SELECT 'EXPERTISE', id, 'CONTRIBUTOR', contributor_id, 'CONTRIBUTOR_EXPERT_IN_DOMAIN', 'STORED' FROM expid WHERE contributor_id IN (SELECT id FROM ctr) "
        "UNION ALL SELECT 'DECISION', a.id, 'DECISION', b.id, 'DECISION_DEPENDS_ON_DECISION', 'DERIVED' FROM (SELECT id, lower(content) AS c FROM dec) a JOIN (SELECT id, lower(id) AS i, lower(reference) AS r FROM dec) b ON a.id <> b.id AND (contains(a.c, b.r) OR contains(a.c, b.i)) "
        "UNION ALL SELECT 'FACT', a.id, 'FACT', b.id, 'FACT_SUPPORTS_FACT', 'DERIVED' FROM (SELECT DISTINCT a.id, b.id AS id2 FROM fact a JOIN fact b ON lower(a.object) = lower(b.subject) AND a.id <> b.id) a JOIN fact b ON b.id = a.id2 "
        "UNION ALL SELECT 'EXPERTISE', a.id, 'EXPERTISE', b.id, 'DOMAIN_RELATES_TO_DOMAIN', 'DERIVED' FROM expid a JOIN expid b ON a.contributor_id = b.contributor_id AND a.domain < b.domain))",
    ),
    "knodes": (
        ("dec", "fact", "evt", "intent", "ctr", "expid"),
        "SELECT 'nod_' || sha256('repo_main:' || node_type || ':' || entity_id) AS id, node_type, entity_id FROM (SELECT 'DECISION' AS node_type, id AS entity_id FROM dec UNION ALL SELECT 'FACT', id FROM fact UNION ALL SELECT 'EVENT', id FROM evt UNION ALL SELECT 'INTENT', id FROM intent UNION ALL SELECT 'CONTRIBUTOR', id FROM ctr UNION ALL SELECT 'EXPERTISE', id FROM expid)",
    ),
    "kdegree": (("kgraph",), "SELECT id, count(*) AS degree FROM (SELECT from_node_id AS id FROM kgraph UNION ALL SELECT to_node_id FROM kgraph) GROUP BY 1"),
    "ktop": (("knodes", "kdegree"), "SELECT n.id, node_type, entity_id, coalesce(degree, 0) AS degree FROM knodes n LEFT JOIN kdegree USING (id) ORDER BY 4 DESC, node_type, n.id LIMIT 200"),
    "nodes": ((), " UNION ALL ".join(f"SELECT {e} AS id, '{k}' AS node_type FROM {t}" for t, e, k in NODES)),
    "edges": ((), " UNION ALL ".join(f"SELECT {a} AS from_id, {b} AS to_id, '{k}' AS edge_type FROM {t}" for t, a, b, k in EDGES)),
    "entities": ((), f"SELECT {select_list(ENTITY)} FROM part"),
    "calls": ((), "SELECT DISTINCT 'part:' || a.l_partkey AS from_id, 'part:' || b.l_partkey AS to_id, 'CALLS' AS relationship_type FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"),
    "dec_words": (("dec",), f"SELECT id, unnest({_words('title')}) AS word FROM dec"),
    "evt_words": (("evt",), f"SELECT id, unnest({_words('title')}) AS word FROM evt"),
    "fact_words": (("fact",), f"SELECT DISTINCT id, unnest(list_concat({_words('subject')}, {_words('object')})) AS word FROM fact"),
    "docs": (("evt", "dec", "fact"), r"SELECT id, 'EVENT' AS entity_type, title, description || ' ' || event_type AS content FROM evt UNION ALL SELECT id, 'DECISION', title, regexp_replace(status || ' ' || regexp_replace(array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT starts_with(regexp_replace(x, '^\s+', ''), '#')), ' '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') FROM dec UNION ALL SELECT id, 'FACT', subject, predicate || ' ' || object FROM fact"),
    "degree": (("edges",), "SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) GROUP BY 1"),
    "paths": (("edges",), "SELECT from_id AS start_id, to_id AS end_id, 1 AS hops FROM edges UNION ALL SELECT p.start_id, e.to_id, p.hops + 1 FROM paths p JOIN edges e ON p.end_id = e.from_id WHERE p.hops < 10"),
    "disc": (("nodes", "degree", "paths", "exp"), "SELECT node_type AS entity_type, id AS entity_id, CAST(coalesce(degree, 0) + coalesce(n, 0) AS DOUBLE) AS score FROM nodes LEFT JOIN degree USING (id) LEFT JOIN (SELECT start_id AS id, count(*) AS n FROM paths GROUP BY 1) USING (id) WHERE node_type IN ('DECISION', 'FACT', 'EVENT') UNION ALL SELECT 'CONTRIBUTOR', contributor_id, CAST(count(*) + count(DISTINCT domain) AS DOUBLE) FROM exp GROUP BY contributor_id"),
}


def sql(body: str, *needs: str) -> str:
    """WITH the needed parts, in order, and the body."""
    seen: list[str] = []

    def add(name: str) -> None:
        for n in PARTS[name][0]:
            if n not in seen:
                add(n)
        if name not in seen:
            seen.append(name)

    for n in needs:
        add(n)
    if not seen:
        return body
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({PARTS[n][1]})" for n in seen) + " " + body
