"""Readers, traces, the knowledge graph and topics against small tables and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from annalist import storage
from annalist.operators import graph, link, rank, readers, snapshot, topics, traces


def plain_expand(hits, links):
    """One pass over the links in their order; what a link adds counts for later ones."""
    seen = set(hits)
    for _, a, b in sorted(links):
        if a in seen or b in seen:
            seen |= {a, b}
    return seen


def test_expand_equals_one_pass(spark):
    rng = random.Random(3)
    for n in range(3):
        links = sorted({(rng.choice("xyz"), f"m{rng.randint(0, 12)}", f"c{rng.randint(0, 12)}") for _ in range(18)})
        hits = ["m1", "c2", "nowhere"]
        rows = spark.createDataFrame(links, "relationship_type string, memory_id string, code_id string")
        got = topics.expand(spark.createDataFrame([(h,) for h in hits], "node string"), rows)
        assert {r.node for r in got.collect()} == plain_expand(hits, links), n


def test_expand_does_not_go_back(spark):
    """A link before the one that adds its end is not taken: one pass, not a closure."""
    links = spark.createDataFrame([("a", "m2", "c2"), ("b", "m1", "c2"), ("c", "m3", "c2")], "relationship_type string, memory_id string, code_id string")
    got = topics.expand(spark.createDataFrame([("m1",)], "node string"), links)
    assert {r.node for r in got.collect()} == {"m1", "c2", "m3"}


def test_path_counts_equal_listed_paths(spark):
    rng = random.Random(8)
    pairs = {(f"t{a}", f"t{b}") for a, b in [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (6, 1)]} | {("u1", "u2"), ("u2", "u3"), ("u3", "u1"), ("v", "u1")} | {(f"w{i}", f"w{i + 1}") for i in range(14)}
    pairs |= {(f"g{rng.randint(0, 5)}", f"g{rng.randint(0, 5)}") for _ in range(9)}
    edges = spark.createDataFrame([*sorted(pairs), ("t1", "t2")], "from_id string, to_id string")  # one edge twice
    starts = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct()
    listed = graph.simple_paths(edges, starts).groupBy(F.col("nodes")[0].alias("id")).agg(F.count(F.lit(1)).alias("paths"))
    assert {tuple(r) for r in graph.path_counts(edges, starts).collect()} == {tuple(r) for r in listed.collect()}


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 37 % 101, f"x{i % 5}") for i in range(101)], "a int, b string").repartition(7)
    got = rank.numbered(rows, F.desc("b"), "a").collect()
    want = sorted(((r.b, r.a) for r in got), key=lambda r: ([-ord(c) for c in r[0]], r[1]))
    assert {(r.b, r.a): r.position for r in got} == {k: i for i, k in enumerate(want, 1)}


def test_decision_references(spark):
    """Every wording, against the rule on all pairs."""
    key = "decision_" + "ab" * 32
    texts = {
        "d1": "We follow this. See docs/adr/2.md for more",
        "d2": f"depends on: {key} and [x](docs/adr/3.md)",
        "d3": f"as told in docs/adr/1.md, and [{key}]",
        key: "based on docs/adr/2.md.",
        "d5": f"mentions {key} only",
        "d6": "nothing at all. docs/adr/22.md; docs/adr/2.mdx",
        "d7": "see RFC.txt and old/RFC.txt (docs/adr/1.md)",
        "d8": None,
    }
    refs = {"d1": "docs/adr/1.md", "d2": "docs/adr/2.md", "d3": "docs/adr/3.md", key: "x/y.md", "d5": "RFC.txt", "d6": "docs/adr/6.md", "d7": "", "d8": "docs/adr/8.md"}
    rows = spark.createDataFrame([(i, refs[i], t) for i, t in texts.items()], "id string, reference string, content string")

    def rule(c, i, r):
        said = [f"[{i}]", f"see {i}", f"depends on {i}", f"depends on: {i}"] + ([f"]({r})", f"see {r}", f"depends on {r}", f"depends on: {r}"] if r else [])
        return "explicit_reference" if any(x in c for x in said) else "source_reference" if r and r in c else "decision_id" if i in c else None

    want = {(a, b, e) for a, t in texts.items() for b in texts if a != b and t and (e := rule(t.lower(), b.lower(), refs[b].lower()))}
    want -= {("d6", "d2", "source_reference")}  # docs/adr/2.mdx holds the reference inside a longer name: names are whole here
    assert {tuple(r) for r in link.decision_dependencies(rows).collect()} == want


@pytest.fixture(scope="module")
def memory(spark):
    intents = spark.createDataFrame([("i1", "s1", "Reduce Latency"), ("i2", "s1", "Improve Safety"), ("i3", "s2", "Optimize")], "id string, source_id string, description string")
    decisions = spark.createDataFrame([("d1", "s1", "Adopt Redis", "docs/1.md", ""), ("d2", "s2", "Use Queue", "docs/2.md", "see docs/1.md")], "id string, source_id string, title string, reference string, content string")
    events = spark.createDataFrame([("e1", "Introduce Redis Cache"), ("e2", "Add Queue"), ("e3", "Other")], "id string, title string")
    facts = spark.createDataFrame([("f1", "Auth", "USES", "Redis"), ("f2", "Redis", "USES", "Disk")], "id string, subject string, predicate string, object string")
    return intents, decisions, events, facts


def test_traces(spark, memory):
    intents, decisions, events, facts = memory
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    trace = traces.trace_decisions(ids("d1", "gone"), intents, decisions, events, facts)
    assert {tuple(r) for r in trace.collect()} == {("d1", "INTENT", "i1", "Reduce Latency"), ("d1", "INTENT", "i2", "Improve Safety"), ("d1", "EVENT", "e1", "Introduce Redis Cache"), ("d1", "FACT", "f1", "Auth USES Redis"), ("d1", "FACT", "f2", "Redis USES Disk")}
    back = traces.trace_events(ids("e1"), intents, decisions, events)
    assert [r.reason for r in traces.reasons(back, True).orderBy("position").collect()] == ["Caused by decision: Adopt Redis", "Driven by intent: Reduce Latency", "Driven by intent: Improve Safety"]
    assert {(r.kind, r.entity_id) for r in traces.intent_impact(ids("i3"), intents, decisions, events).collect()} == {("DECISION", "d2"), ("EVENT", "e2")}
    assert {(r.kind, r.entity_id) for r in traces.fact_impact(ids("f1"), facts, decisions, events).collect()} == {("DECISION", "d1"), ("EVENT", "e1")}
    assert traces.trace_decisions(ids("gone"), intents, decisions, events, facts).count() == 0


def test_snapshot(spark, memory):
    intents, decisions, events, facts = memory
    who = spark.createDataFrame([("c1", "Ann", "a@x")], "id string, name string, email string")
    skill = spark.createDataFrame([("x1", "c1", "A", 1.0), ("x2", "c1", "B", 0.5), ("x3", "c9", "A", 0.1)], "id string, contributor_id string, domain string, score double")
    tables = (decisions, facts, events, intents, who, skill)
    nodes, edges = snapshot.nodes("r", *tables), snapshot.edges("r", *tables)
    kinds = {r.edge_type: r.n for r in edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert nodes.count() == 2 + 2 + 3 + 3 + 1 + 3 and nodes.select("id").distinct().count() == nodes.count()
    assert kinds == {"INTENT_DRIVES_DECISION": 3, "DECISION_RESULTS_IN_EVENT": 2, "FACT_SUPPORTS_DECISION": 2, "CONTRIBUTOR_EXPERT_IN_DOMAIN": 2, "DECISION_DEPENDS_ON_DECISION": 1, "FACT_SUPPORTS_FACT": 1, "DOMAIN_RELATES_TO_DOMAIN": 1}
    assert {r.edge_type for r in snapshot.edges("r", *tables, derived=False).collect()} & {"FACT_SUPPORTS_FACT"} == set()
    told = edges.where("edge_type = 'DOMAIN_RELATES_TO_DOMAIN'").first().evidence
    assert '"contributor_name":"Ann"' in told and '"domain_a":"A"' in told
    top = snapshot.top_nodes(nodes, edges, 3)
    assert top.count() == 3 and snapshot.induced(top, edges).count() <= edges.count()
    most = top.orderBy(F.desc("degree"), "node_type", "id").first()
    assert snapshot.node_detail(edges, most.id).count() == most.degree
    assert [r.position for r in snapshot.suggested_questions(nodes, edges).collect()] == [1, 2]
    none = edges.where("false")
    assert [r.question for r in snapshot.suggested_questions(nodes, none).collect()] == ["What are the main architectural decisions in this repository?"]
    assert snapshot.filter_nodes(nodes, "all", "X2").count() == 1


def test_readers(spark, memory):
    _, decisions, events, facts = memory
    assert readers.get(decisions, "d1").title == "Adopt Redis"
    with pytest.raises(LookupError):
        readers.get(decisions, "d9")
    skill = spark.createDataFrame([("e1", "Storage"), ("x1", "Agent")], "id string, domain string")
    ids = spark.createDataFrame([("d2",), ("f1",), ("e1",), ("x1",), ("no",), ("e1",)], "id string")
    assert {tuple(r) for r in readers.resolve(ids, decisions, facts, events, skill).collect()} == {("d2", "DECISION", "Use Queue"), ("f1", "FACT", "Auth USES Redis"), ("e1", "EVENT", "Introduce Redis Cache"), ("x1", "EXPERTISE", "Agent")}
    of = lambda *paths: readers.dominant_language(spark.createDataFrame([(p,) for p in paths], "path string")).first()[0]
    assert of("a/b.PY", "c.go", "d.go") == "go" and of("a.rs", "b.py") == "python" and of("x.go", "y.go", "package.json") == "javascript" and of("README") == "" and of() == ""


def test_tables_are_written_once(spark, tmp_path):
    path, built = f"{tmp_path}/t.parquet", []

    def build():
        built.append(1)
        return spark.read.parquet(path).where("id > 2")

    spark.range(5).write.parquet(path)
    for _ in range(3):
        assert storage.once(spark, storage.fingerprint(spark, path), "some", build).count() == 2
    assert len(built) == 1
    spark.range(9).write.mode("overwrite").parquet(path)  # a changed input gives a new table
    assert storage.once(spark, storage.fingerprint(spark, path), "some", build).count() == 6 and len(built) == 2


def test_plan_steps_and_topics():
    assert topics.plan_steps(0, 0, []) == ["1. Run analyze_topic_impact before broad refactors.", "2. Run review on the task topic before merge."]
    assert topics.plan_steps(1, 1, list("abcde"))[2] == "3. Begin at starting points: a, b, c, d (+1 more)."
    assert topics.topic_terms(topics.normal_topic("  Add  a LOGIN ")) == ["add", "login"]


def test_queries_build_no_more_than_they_read(spark, monkeypatch):
    """Nodes need no edges, derived edges no pairs by words, and a search by domain no index of texts."""
    from annalist import catalog, catalog_answers
    from annalist.operators import link, search, snapshot
    from annalist.plans.knowledge import Knowledge

    def fail(*_, **__):
        raise AssertionError("not needed")

    k = Knowledge(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(search, "counted_words", fail)
    monkeypatch.setattr(search, "postings", fail)
    assert catalog.domain_query(k).count() > 0
    monkeypatch.setattr(link, "decision_event", fail)
    assert catalog_answers.derived_degrees(k).count() > 0
    monkeypatch.setattr(snapshot, "edges", fail)
    assert catalog_answers.knowledge_nodes(k).count() > 0 and catalog_answers.filter_nodes(k).count() >= 0


def test_questions_by_edge_types_need_no_nodes(spark, memory):
    """Edges name the types of their ends, so no node is joined to them (F36)."""
    intents, decisions, events, facts = memory
    who = spark.createDataFrame([("c1", "Ann", "a@x")], "id string, name string, email string")
    skill = spark.createDataFrame([("x1", "c1", "A", 1.0), ("x2", "c1", "B", 0.5)], "id string, contributor_id string, domain string, score double")
    tables = (decisions, facts, events, intents, who, skill)
    nodes, edges = snapshot.nodes("r", *tables), snapshot.edges("r", *tables)
    assert snapshot.suggested_questions(None, edges).collect() == snapshot.suggested_questions(nodes, edges).collect()
    assert [r.position for r in snapshot.suggested_questions(None, edges.where("from_node_id = to_node_id")).collect()] == [1]


def test_references_are_searched_in_lines_that_can_hold_one(spark):
    """Prose without a name is read past; names behind wordings, in runs and at line ends are found all the same (F42)."""
    import time

    prose = "plainwordswithoutanysign" * 10_000 + " and so on. "
    texts = [prose + "\nSee docs/b.md.", "oversee docs/b.md", "x [a_b/docs/b.md]", "ends.\n(docs/b.md)...", "a.b.docs/b.md", prose]
    rows = [(f"d{n}", f"docs/{n}.md", x) for n, x in enumerate(texts)] + [("dx", "docs/b.md", "")]
    begun = time.time()
    found = {(r.from_id, r.evidence) for r in link.decision_dependencies(spark.createDataFrame(rows, "id string, reference string, content string")).collect()}
    assert found == {("d0", "explicit_reference"), ("d1", "explicit_reference"), ("d2", "source_reference"), ("d3", "source_reference")}
    assert time.time() - begun < 30  # a search from each place of a long run would take minutes
