import datetime as dt

from pyspark.sql import functions as F

from annalist import catalog, storage
from annalist.constants import DOMAIN_KEYWORDS
from annalist.functions import text as t
from annalist.operators import extract, link, ownership, rank
from annalist.plans.knowledge import Knowledge
from tests.test_text import SOURCE

ANCHOR = dt.datetime(2024, 6, 1, 12)


def commit(id, author, title, days):
    return (id, "r", "commit", id, title, author, ANCHOR - dt.timedelta(days=days), None, None)


def sample(spark):
    rows = [
        commit("a1", "Alice <alice@example.com>", "feat(auth): implement token logins", 1),
        commit("b1", "Bob <bob@example.com>", "fix: configure db persistence queries", 0),
        commit("b2", "Bobby Longname <bob@example.com>", "chore: update session cookie token handling", 32),
        commit("n", "", "feat: token", 5),
    ]
    return spark.createDataFrame(rows, SOURCE)


def test_contributors(spark):
    rows = {r.email: r for r in ownership.contributors(sample(spark)).collect()}
    assert set(rows) == {"alice@example.com", "bob@example.com"}
    bob = rows["bob@example.com"]
    assert (bob.name, bob.commit_count, bob.last_seen - bob.first_seen) == ("Bobby Longname", 2, dt.timedelta(days=32))


def test_expertise(spark):
    sources = sample(spark)
    decisions = spark.createDataFrame([("d1", "Login tokens", "a1")], "id string, title string, source_id string")
    facts = spark.createDataFrame([("f1", "Auth", "USES", "x", "a1")], "id string, subject string, predicate string, object string, source_id string")
    rows = {(r.contributor_id, r.domain): r for r in ownership.expertise(sources, ownership.contributors(sources), extract.events(sources), decisions, facts).collect()}
    who = {r.email: r.id for r in ownership.contributors(sources).collect()}
    alice, bob = rows[who["alice@example.com"], "Authentication"], rows[who["bob@example.com"], "Authentication"]
    assert (alice.commits, alice.decisions, alice.facts, alice.events, alice.score, alice.recent) == (1, 1, 1, 1, 1.0, True)
    assert (bob.score, bob.recent) == (round(4 / 11, 6), False)
    assert rows[who["bob@example.com"], "Storage"].score == 1.0


def test_links(spark):
    decisions = spark.createDataFrame([("d1", "Introduce Redis Cache", "s1"), ("d2", "Use the new", "s2")], "id string, title string, source_id string")
    events = spark.createDataFrame([("e1", "Add redis"), ("e2", "Add the")], "id string, title string")
    facts = spark.createDataFrame([("f1", "A", "uses", "CACHE", "s1"), ("f2", "cache", "uses", "B", "s9")], "id string, subject string, predicate string, object string, source_id string")
    intents = spark.createDataFrame([("i1", "s1"), ("i2", "")], "id string, source_id string")
    pairs = lambda df: {(r.from_id, r.to_id) for r in df.collect()}
    assert pairs(link.intent_decision(intents, decisions)) == {("i1", "d1")}
    assert pairs(link.decision_event(decisions, events)) == {("d1", "e1")}
    assert pairs(link.fact_decision(facts, decisions)) == {("f1", "d1"), ("f2", "d1")}
    assert pairs(link.fact_support(facts)) == {("f1", "f2")}
    assert link.stored_edges(intents, decisions, events, facts).count() == 4


def test_decision_dependencies(spark):
    d = "decision_" + "a" * 64
    rows = [(d, "docs/adr/1.md", "nothing"), ("d2", "docs/adr/2.md", "See docs/adr/1.md"), ("d3", "docs/adr/3.md", "cf docs/adr/2.md. depends on docs/adr/2.md"), ("d4", "docs/adr/4.md", f"as in {d}, docs/adr/4.md"), ("d5", "docs/adr/5.md", "in docs/adr/1.md")]
    found = link.decision_dependencies(spark.createDataFrame(rows, "id string, reference string, content string")).collect()
    assert {(r.from_id, r.to_id, r.evidence) for r in found} == {("d2", d, "explicit_reference"), ("d3", "d2", "explicit_reference"), ("d4", d, "decision_id"), ("d5", d, "source_reference")}


def test_domain_pairs(spark):
    rows = spark.createDataFrame([("c", "B"), ("c", "A"), ("c", "C"), ("d", "A")], "contributor_id string, domain string")
    assert {(r.domain_a, r.domain_b) for r in link.domain_pairs(rows).collect()} == {("A", "B"), ("A", "C"), ("B", "C")}


def test_domains_are_those_of_expertise(spark):
    def record(id, author, title, content, kind="adr"):
        return (id, "r", kind, id, title, author, None, content, None)

    alice, bob, carl, dora, eve = [f"{n} <{n.lower()}@example.com>" for n in ("Alice", "Bob", "Carl", "Dora", "Eve")]
    rows = [
        commit("a1", alice, "feat: \u017fession", 1),  # a long s: the event's title alone says session
        commit("b1", bob, "wip", 1),
        commit("c1", carl, "Fix: SQL", 1), commit("c1", dora, "docs: mcp", 1),  # one id, two authors
        commit("e1", eve, None, 1), commit(None, eve, "feat: token", 1), commit("n", "", "feat: docker", 1),
        record("r1", bob, "Adopt", "A plain line, docker\nThe pass*word* uses x and a mcp CALLS y\nThe \u017fql uses z; sql"),
        record("r2", "Fay", "Adopt tokens", "It uses sql"),  # no commit
        record("r3", alice, "Render", "It uses docker", "architecture_doc"),
        record("r4", alice, "x", None), record("r5", None, "sql", "It uses sql"), record(None, eve, "sql", "It uses sql"),
        record("r6", dora, "Agent", "a depends\non sql"), record("r6", alice, "x", "b calls CI/CD"),
    ]
    sources = spark.createDataFrame(rows, SOURCE)
    people = ownership.contributors(sources)
    whole = ownership.expertise(sources, people, extract.events(sources), extract.decisions(sources), extract.facts(sources))
    found = [(r.contributor_id, r.domain) for r in ownership.domains(sources).collect()]
    assert sorted(found) == sorted((r.contributor_id, r.domain) for r in whole.select("contributor_id", "domain").collect())
    email = {r.id: r.email[0] for r in people.collect()}
    by = {}
    for c, d in found:
        by.setdefault(email[c], set()).add(d)
    assert by == {
        "a": {"Authentication", "Context Engine", "Agent Intelligence", "Infrastructure"}, "b": {"Authentication", "Storage", "MCP"},
        "c": {"Storage", "MCP"}, "d": {"Storage", "MCP", "Agent Intelligence", "Infrastructure"},
    }


def test_domain_pairs_write_no_table_of_texts(spark):
    k = Knowledge(spark, "/root/testdata/sf0.001")
    k._state = ("a state of its own",)
    first = {tuple(r) for r in catalog.derive_domain_pairs(k).collect()}
    assert first and not any(storage.kept(spark, k._state, name) for name in ("events", "facts", "contributors", "expertise"))
    # expertise that is written already is read
    k = Knowledge(spark, "/root/testdata/sf0.001")
    assert k.expertise.count() and storage.kept(spark, k._state, "expertise")
    assert {tuple(r) for r in catalog.derive_domain_pairs(k).collect()} == first


def test_no_predicate_holds_a_word_of_a_domain():
    """``ownership._spoken`` reads no statement without such a word."""
    words = [w for own in DOMAIN_KEYWORDS.values() for w in own]
    assert not any(w in name.lower() for w in words for name, _ in t.PREDICATES) and not any(w.split() != [w] or not w.isascii() or set(w) & set("*_`#") for w in words)


def test_packing_skips_what_does_not_fit(spark):
    rows = [("k", str(i), "x", s, c) for i, (s, c) in enumerate([(30, 6), (20, 9), (10, 3), (10, 1), (0, 1), (0, 0)])]
    ranked = spark.createDataFrame(rows, "kind string, id string, text string, score int, cost int")
    assert {r.id for r in rank.compress_pack(ranked, 10).collect()} == {"0", "2", "3", "5"}
    assert rank.compress_pack(ranked, 0).count() == 0
    everything = spark.range(500).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("text"), (F.col("id") % 7).cast("int").alias("score"), (1 + F.col("id") % 5).cast("int").alias("cost"))
    used, want = 0, set()
    for r in sorted(everything.collect(), key=lambda r: (-r.score, r.text, r.id)):
        if used + r.cost <= 60:
            used += r.cost
            want.add(r.id)
    assert {r.id for r in rank.compress_pack(everything, 60).collect()} == want


def test_boost_runs_in_order():
    assert rank.relation_boost({"a": 10}, [("a", "b"), ("b", "c"), ("x", "y")]) == {"a": 12, "b": 6, "c": 2}


def test_features_and_authors(spark):
    events = spark.createDataFrame([("FEATURE_INTRODUCED", "Redis"), ("FEATURE_INTRODUCED", "redis"), ("FEATURE_INTRODUCED", "storage"), ("DEFECT_RESOLVED", "x")], "event_type string, title string")
    decisions = spark.createDataFrame([("MCP and Storage",)], "title string")
    found = {r.name.lower(): (r.sources, r.event_count) for r in rank.features(events, decisions).collect()}
    assert found["redis"] == ("feature_event", 2) and found["storage"] == ("expertise_domain,feature_event", 1) and found["mcp"] == ("decision,expertise_domain", 0)
    sources = spark.createDataFrame([("redis cache", "r", "", "A"), ("redis", "r", "", ""), ("x", "r", "", "B")], "title string, reference string, content string, author string")
    assert {(r.author, r.score) for r in rank.author_evidence(sources, ["redis", "cache"]).collect()} == {("A", 2), ("unknown", 1)}


def test_keys_equal_hashlib(spark):
    from hashlib import sha256

    assert spark.range(1).select(t.sha_key("k_", F.lit("a"), F.lit("b")).alias("x")).first().x == "k_" + sha256(b"a:b").hexdigest()


def test_rules_read_authors_once_each(spark):
    """Authors' names are read behind the counting of commits, not on each commit (F40, F43)."""
    rows = spark.createDataFrame([(f"e{n}", "r", "commit", f"title {n}", "Ann <a@x.org>" if n % 2 else "A. <a@x.org>", "2024-01-01 00:00:00") for n in range(6)], "id string, repository_id string, source_type string, title string, author string, ts string")
    found = ownership.contributors(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in plan[plan.rindex("+- Filter") :]
    assert [(r["email"], r["commit_count"]) for r in found.collect()] == [("a@x.org", 6)]


def test_white_space_is_that_of_the_regular_expression(spark):
    every = spark.range(1, 0x3100).where("id < 55296").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    text = F.concat("c", F.lit(" a "), "c", F.lit("b"), "c", "c")
    assert every.where(F.regexp_replace(text, r"(?U)^\s+|\s+$", "") != t.squeeze(text)).count() == 0


def test_statements_of_lines_without_words_are_not_cut_up(spark):
    text = "No such thing here, and none there\nIt USES a lamp and the Well calls a Bell; x\n\nDepends on nothing"
    row = spark.createDataFrame([("a", "r", "adr", "t", text)], "id string, repository_id string, source_type string, title string, content string")
    assert sorted((r["subject"], r["predicate"], r["object"]) for r in extract.facts(row).collect()) == [("It", "USES", "A Lamp"), ("The Well", "CALLS", "A Bell")]
