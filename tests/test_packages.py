"""Packages of answers and the workspace on small tables."""

import json
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from annalist import storage
from annalist.operators import graph, packages, workspace

ENTITY = "id string, entity_type string, name string, qualified_name string, package_path string, file_path string, start_line int, end_line int, signature string"
NOW = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def code_tables(spark):
    entities = [("s1", "struct", "T", "pkg/a.T", "pkg/a", "pkg/a/t.go", 3, 9, "X int; Y int"), ("f1", "function", "Run", "pkg/a.Run", "pkg/a", "pkg/a/t.go", 11, 12, "func Run(...)"), ("f2", "function", "Run", "pkg/b.Run", "pkg/b", "pkg/b/r.go", 0, 0, None), ("p1", "package", "a", "pkg/a", "pkg/a", "", None, None, None)]
    entities += [(f"m{n}", "method", f"M{n}", f"pkg/a.T.M{n}", "pkg/a", "pkg/a/t.go", 20 + n, 20 + n, "") for n in range(8)]
    relations = [("f1", "s1", "CALLS"), ("f1", "s1", "REFERENCES"), ("s1", "gone", "CALLS"), ("s1", "f2", "DEPENDS_ON"), ("f2", "f1", "CALLS"), ("s1", "p1", "IMPORTS")]
    return spark.createDataFrame(entities, ENTITY), spark.createDataFrame(relations, "from_id string, to_id string, relationship_type string")


def test_briefings(spark, code_tables):
    entities, relations = code_tables
    links = spark.createDataFrame([("s1", "d1", "Use T"), ("s1", "d1", "Use T"), ("f9", "d2", "Other")], "code_id string, memory_id string, label string")
    rows = packages.briefings(entities, entities, relations, links).orderBy("position").collect()
    assert [r.qualified_name for r in rows] == ["pkg/a.T", "pkg/a.Run", "pkg/b.Run", *[f"pkg/a.T.M{n}" for n in range(5)]]
    first = rows[0]
    assert (first.fields, first.members, first.defined_in) == ("X int; Y int", ",".join(f"pkg/a.T.M{n}" for n in range(6)), "pkg/a/t.go:3-9")
    assert (first.producers, first.consumers, first.decisions, first.role) == ("pkg/a.Run", "pkg/b.Run", "Use T", "struct T — a (public API surface)")
    assert rows[1].fields == "" and rows[1].signature == "func Run(...)" and rows[2].defined_in == "pkg/b/r.go"
    assert packages.briefings(entities.where("false"), entities, relations, links).count() == 0


def test_symbols_need_a_package_where_names_repeat(code_tables):
    with pytest.raises(ValueError):
        packages.resolve_symbol(*code_tables, "run")
    with pytest.raises(LookupError):
        packages.resolve_symbol(*code_tables, "nothing")
    rows = {(r.section, r.id) for r in packages.resolve_symbol(*code_tables, "Run", "pkg/b").collect()}
    assert rows == {("code", "f2"), ("dependencies", "f1"), ("call_graph", "f2>f1"), ("call_graph", "f1>s1"), ("call_graph", "s1>gone")}


def test_explain_plan_and_impact(spark, code_tables):
    entities, relations = code_tables
    found = spark.createDataFrame([("repository", "d1"), ("repository", "f9"), ("repository", "x1"), ("code", "s1")], "side string, id string")
    known = spark.createDataFrame([("d1", "DECISION", "Use T"), ("f9", "FACT", "A USES T"), ("x1", "EXPERTISE", "Storage")], "entity_id string, entity_type string, label string")
    bridge = spark.createDataFrame([("DECISION_REFERENCES_CODE", "d1", "s1"), ("DECISION_REFERENCES_CODE", "d7", "s1")], "relationship_type string, memory_id string, code_id string")
    said = {(r.section, r.id, r.label) for r in packages.explain(found, entities, relations, known, bridge).collect()}
    assert said >= {("code", "s1", "pkg/a.T"), ("repository", "d1", "Use T"), ("links", "d1", "s1"), ("dependencies", "f2", "pkg/b.Run"), ("call_graph", "s1>gone", None)} and not any(x == "d7" for _, x, _ in said)
    nodes = spark.createDataFrame([("n1", "DECISION", "d1"), ("n2", "EVENT", "e1"), ("n3", "EVENT", "e2"), ("n4", "INTENT", "i1"), ("n5", "FACT", "f9")], "id string, node_type string, entity_id string")
    edges = spark.createDataFrame([("n1", "n2"), ("n2", "n3"), ("n3", "n1"), ("n4", "n1")], "from_node_id string, to_node_id string")
    hit = {(r.section, r.id) for r in packages.topic_impact(found, known, nodes, edges, entities, relations).collect()}
    assert hit == {("impacted_decisions", "d1"), ("impacted_facts", "f9"), ("impacted_events", "e1"), ("impacted_events", "e2"), ("dependent_areas", "x1"), ("code_relations", "s1")}
    skill = spark.createDataFrame([("EXPERTISE", "x1", "Storage"), ("CONTRIBUTOR", "c1", "c1")], "kind string, id string, label string")
    people = spark.createDataFrame([("c2", "Ann")], "contributor_id string, name string")
    rows = {(r.section, r.id, r.label) for r in packages.plan(found, entities, known, skill, nodes, edges, people).collect()}
    assert rows == {("impacted_areas", "s1", "pkg/a.T"), ("starting_points", "s1", "pkg/a.T"), ("impacted_areas", "x1", "Storage"), ("impacted_areas", "e1", "e1"), ("impacted_areas", "e2", "e2"), ("relevant_decisions", "d1", "Use T"), ("starting_points", "d1", "Use T"), ("relevant_facts", "f9", "A USES T"), ("owners", "x1", "Storage"), ("owners", "c1", "c1"), ("reviewers", "c2", "Ann")}


def test_sessions_and_workflows(spark):
    """Rows, all of them: in order of artifact and section, then by rank, type, id and label."""
    rows = packages.items(spark.createDataFrame([("b", 2.0), ("a", 1.0), ("c", 2.0)], "x string, n double"), "THING", "x", None, "n")
    many = packages.items(spark.range(300).select(F.col("id").cast("string").alias("x")), "THING", "x")
    context = packages.context("repository", [many, rows, rows, many])
    own = packages.session("repository", "r", "", context)
    got = packages.delivered(own).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 607)) and {r.package_id for r in got} == {packages.package_id("ses", "r", "repository", "default")}
    assert [(r.section, r.source) for r in got[:300]] == [("Repository Overview", "context")] * 300
    assert [(r.section, r.id, r.score) for r in got[300:306]] == [("Discovery", "b", 2.0), ("Discovery", "c", 2.0), ("Discovery", "a", 1.0), ("Learning Path", "b", 2.0), ("Learning Path", "c", 2.0), ("Learning Path", "a", 1.0)]
    about = packages.context("domain", [many, rows, rows])
    assert {(r.artifact, r.artifact_type) for r in packages.session("domain", "r", "Storage", about, rows).collect()} == {(1, "context_package"), (2, "search_result")}
    flow = packages.delivered(packages.workflow("knowledge_exploration", "r", "redis", {"session": context, "search_result": rows})).orderBy("position").collect()
    assert len(flow) == 609 and [(r.artifact_type, r.source, r.id) for r in flow[-3:]] == [("search_result", "search", x) for x in "bca"]
    for bad in (lambda: packages.session("domain", "r", "", context, rows), lambda: packages.workflow("onboarding", "r", "", {}), lambda: packages.workflow("knowledge_exploration", "r", " ", {"session": own, "search_result": rows}), lambda: packages.context("domain", [rows])):
        with pytest.raises(ValueError):
            bad()


def test_contributor_plan(spark):
    """Whoever has an edge in from the way to the start."""
    nodes = spark.createDataFrame([("c", "CONTRIBUTOR", "ann"), ("x", "EXPERTISE", "x1"), ("d", "DECISION", "d1"), ("e", "EVENT", "e1"), ("z", "CONTRIBUTOR", "bob")], "id string, node_type string, entity_id string")
    edges = spark.createDataFrame([("x", "c"), ("d", "x"), ("e", "d"), ("c", "z"), ("e", "e")], "from_id string, to_id string")
    plan = lambda start: {tuple(r) for r in graph.contributor_plan(edges, nodes, nodes.where(f"id = '{start}'").select("id")).collect()}
    assert plan("c") == {("CONTRIBUTOR", "ann", 1), ("DECISION", "d1", 1)} and plan("e") == set()


def test_onboarding(spark):
    decisions = spark.createDataFrame([("d2", "B"), ("d1", "A")], "id string, title string")
    counts = spark.createDataFrame([("facts", 3)], "kind string, n long")
    rows = {(r.section, r.position): r.text for r in packages.onboard(decisions, counts, ["1. Go."]).collect()}
    assert rows[("key_decisions", 1)] == "A" and rows[("orientation", 1)] == "facts: 3" and rows[("steps", 7)] == "1. Go." and len(rows) == 10


def test_discovery(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", *a], cwd=tmp_path, check=True, capture_output=True)
    with pytest.raises(ValueError):
        workspace.discover(spark, str(tmp_path))
    git("init", "-q", "-b", "trunk")
    assert workspace.discover(spark, str(tmp_path)).select("name", "default_branch").first() == (tmp_path.name, "trunk")
    git("remote", "add", "origin", "git@host:team/thing.git")
    assert workspace.discover(spark, str(tmp_path)).first().name == "thing"
    git("remote", "set-url", "origin", "host:solo.git")
    assert workspace.discover(spark, str(tmp_path)).first().name == "solo"


def test_freshness(spark):
    files = spark.createDataFrame([("a.go", datetime(2024, 1, 1)), ("readme", datetime(2025, 1, 1)), ("go.mod", datetime(2024, 2, 1))], "path string, modified timestamp")
    assert workspace.index_is_current(files, datetime(2024, 3, 1), 1) and not workspace.index_is_current(files, datetime(2024, 3, 1), 2)
    assert not workspace.index_is_current(files, datetime(2024, 1, 15), 1) and not workspace.index_is_current(files, None, 1)
    assert workspace.index_is_current(files.where("false"), NOW, 0)


def test_migrations(spark, tmp_path):
    steps = workspace.Migrations(spark, f"file://{tmp_path}/w")
    with pytest.raises(ValueError):
        steps.rollback()
    assert steps.up() == [1, 2, 3] and steps.up() == [] and steps.applied() == [1, 2, 3]
    assert spark.read.parquet(f"file://{tmp_path}/w/facts").count() == 0
    assert steps.rollback() == 3 and steps.applied() == [1, 2] and not (tmp_path / "w" / "bridge").exists() and steps.up() == [3]


def test_policy(spark, tmp_path):
    of = lambda *paths: workspace.derive_policy(spark.createDataFrame([(p,) for p in paths], "path string"), "r", ("docs/adr", "adr"), NOW)
    rules = of("go.mod", "internal/x.go", "docs/adr/1.md", ".github/workflows/ci.YML", ".github/workflows/a/b.yml", "Jenkinsfile", "pkg2/x.go")
    assert rules["adr_directory"] == "docs/adr" and rules["ci_workflow_files"] == [".github/workflows/ci.YML", "Jenkinsfile"] and rules["dominant_language"] == "go"
    assert [x["prefix"] for x in rules["layer_conventions"]] == ["internal/"] and len(rules["ship_check_hints"]) == 3
    assert of()["ship_check_hints"] == [] and workspace.read_policy(str(tmp_path)) is None
    workspace.write_policy(str(tmp_path), rules)
    assert workspace.read_policy(str(tmp_path)) == rules and [p.name for p in tmp_path.iterdir()] == ["policy.json"]


def test_session_memory(spark):
    one, two = workspace.remembered(spark, "r", " Cache ", "use redis", NOW), workspace.answered(spark, "r", "Why?", "Speed", NOW)
    other = spark.createDataFrame([("fact_x", "r", "adr_1", "A", "USES", "B", NOW)], workspace.FACT)
    facts = one.unionByName(two).unionByName(other)
    assert two.first().object == "Why? => Speed" and workspace.remembered_rows(one.select("subject", F.col("object").alias("content")), "r").first().id == one.first().id
    used = spark.createDataFrame([(two.first().id, datetime(2024, 1, 1), 1)], "id string, last_accessed timestamp, access_count int")
    assert [r.id for r in workspace.listed(facts, "r", used).orderBy("position").collect()] == [two.first().id, one.first().id]
    with pytest.raises(ValueError):
        workspace.forget(facts, "r", "fact_x")
    assert workspace.forget(facts, "r", one.first().id).count() == 2
    bundle = workspace.handoff(facts, "r", used, NOW).first().bundle
    back = workspace.taken_over(spark, bundle)
    assert {r.id for r in back.collect()} == {one.first().id, two.first().id} and json.loads(bundle)["access_ranking"][0] == two.first().id
    assert storage.upsert(facts.withColumn("version", F.lit(0)), back.withColumn("version", F.lit(0))).count() == 3
    for bad in ('{"version": "v2", "repository_id": "r"}', '{"version": "v1"}'):
        with pytest.raises(ValueError):
            workspace.taken_over(spark, bad)
    with pytest.raises(ValueError):
        workspace.remembered(spark, "r", " ", "x", NOW)


def test_doctor(spark):
    of = lambda *a: {r.name: r.status for r in workspace.doctor(spark, *a).collect()}
    assert of(lambda: False, None, None, None, None) == {"workspace": "fail"}
    assert set(of(lambda: True, "c1", "c1", True, {"a": 1}).values()) == {"ok"} and workspace.healthy(workspace.doctor(spark, lambda: True, "c1", "c1", True, {"a": 1}))
    bad = of(lambda: True, "c2", "c1", False, None)
    assert {k for k, v in bad.items() if v == "warn"} == {"git_freshness", "code_index", "policy"}


def test_contributor_context_makes_no_pairs_by_words(spark, monkeypatch):
    """No way to a person holds an edge between memories (F37)."""
    import __spark_entry__ as entry
    from annalist.operators import graph

    given, own = [], graph.contributor_plan
    monkeypatch.setattr(graph, "contributor_plan", lambda edges, nodes, start: given.append(edges) or own(edges, nodes, start))
    entry.queries()["context_contributor"](spark, "/root/testdata/sf0.001")
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "EXPERTISE" in plan and "DECISION" not in plan and "FACT" not in plan


def test_learning_path_sorts_stored_rows(spark, monkeypatch):
    """A sort by ranges reads its rows twice, so discovery is stored first (F32, F41)."""
    import __spark_entry__ as entry
    from annalist.operators import rank

    given, own = [], rank.learning_path
    monkeypatch.setattr(rank, "learning_path", lambda found: given.append(found) or own(found))
    for name in ("learning_repo", "learning_domain"):
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    plans = [g._jdf.queryExecution().optimizedPlan().toString() for g in given]
    assert "Join" not in plans[0] and "Aggregate" not in plans[0] and plans[1].count("Join") == 1


def test_path_counts_of_repeated_edges(spark):
    """Edges that end every path, and edges given twice (F32)."""
    from annalist.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("b", "d"), ("x", "y"), ("p", "q"), ("q", "p")], "from_id string, to_id string")
    found = graph.path_counts(edges, edges.selectExpr("explode(array(from_id, to_id)) AS id").distinct())
    assert {r["id"]: r["paths"] for r in found.collect() if r["paths"]} == {"a": 6, "b": 2, "x": 1, "p": 1, "q": 1}


def test_domain_context_counts_its_own_links_alone(spark, monkeypatch):
    """A domain's reviewers need the links of its events, not those of all memories; a learning path is not numbered before its package is (F24)."""
    import __spark_entry__ as entry
    from annalist.operators import rank
    from annalist.plans.knowledge import Knowledge

    def never(*_):
        raise AssertionError("not needed")

    want = entry.queries()["context_domain"](spark, "/root/testdata/sf0.001").where("section = 'Learning Path'").orderBy("position").select("id").collect()
    assert [r.id for r in want] == [r.entity_id for r in entry.queries()["learning_domain"](spark, "/root/testdata/sf0.001").orderBy("position").collect()]
    monkeypatch.setattr(Knowledge, "link_counts", property(never))
    monkeypatch.setattr(rank, "learning_path", never)
    assert entry.queries()["context_domain"](spark, "/root/testdata/sf0.001").where("source = 'reviewers' AND score > 1").count() > 0


def test_numbering_sorts_bounded_ranges(spark, monkeypatch):
    """A table of more rows is sorted in more ranges, not in larger ones (F34)."""
    from annalist.operators import rank

    monkeypatch.setattr(rank, "RANGE_ROWS", 10)
    got = rank.numbered(spark.range(400).select((F.col("id") * 7 % 400).alias("x"), F.lit(1).alias("y")), "y", F.desc("x"))
    assert [(r.position, r.x) for r in got.orderBy("position").collect()] == [(n, 400 - n) for n in range(1, 401)]
    files = [spark.read.parquet(f).count() for f in got.inputFiles()]
    assert len(files) >= 20 and max(files) <= 40


def test_discovery_adds_up_in_one_aggregate(spark):
    """Several rows of a node's degrees and paths add up, nodes without any and rows of others are told apart, and no side is sorted for a join (F34)."""
    from annalist.operators import rank

    nodes = spark.createDataFrame([("d", "DECISION"), ("f", "FACT"), ("e", "EVENT"), ("e", "EVENT"), ("x", "EXPERTISE")], "id string, node_type string")
    degrees = spark.createDataFrame([("d", 1), ("d", 1), ("x", 5), ("gone", 3)], "id string, degree long")
    paths = spark.createDataFrame([("d", 4), ("e", 2), ("e", 1)], "id string, paths long")
    found = rank.discovery(nodes, degrees, paths, spark.createDataFrame([("c", "A"), ("c", "B")], "contributor_id string, domain string"))
    assert sorted(map(tuple, found.collect())) == [("CONTRIBUTOR", "c", 4.0), ("DECISION", "d", 6.0), ("EVENT", "e", 3.0), ("EVENT", "e", 3.0), ("FACT", "f", 0.0)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_onboarding_makes_discovery_once(spark, monkeypatch):
    """The session and the two reports read the same stored discovery, and no learning path is numbered before the package (F27)."""
    import __spark_entry__ as entry
    from annalist.operators import rank

    made, own = [], rank.discovery
    monkeypatch.setattr(rank, "discovery", lambda *given: made.append(1) or own(*given))
    monkeypatch.setattr(rank, "learning_path", None)
    entry.queries()["workflow_onboarding"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1
