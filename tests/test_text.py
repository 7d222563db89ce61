import pytest
from pyspark.sql import functions as F

from annalist.functions import text as t
from annalist.operators import extract

SOURCE = "id string, repository_id string, source_type string, reference string, title string, author string, ts timestamp_ntz, content string, status string"


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def source(kind, title="", content=None, author="", id="s1", status=""):
    return (id, "r", kind, id, title, author, None, content, status)


@pytest.mark.parametrize(
    "title,event",
    [
        ("feat: add feature", "FEATURE_INTRODUCED"), ("feature: x", "FEATURE_INTRODUCED"), ("fix: x", "DEFECT_RESOLVED"), ("bugfix: x", "DEFECT_RESOLVED"), ("refactor: x", "CODE_REFACTORED"),
        ("docs: x", "DOCUMENTATION_UPDATED"), ("chore: x", "MAINTENANCE_PERFORMED"), ("FEAT: x", "FEATURE_INTRODUCED"), (" feat (a) : x", "FEATURE_INTRODUCED"), ("feat!: x", None), ("wip: x", None), ("initial commit", None), ("", None), (None, None),
    ],
)
def test_commit_event(spark, title, event):
    assert one(spark, t.commit_event, title) == event


@pytest.mark.parametrize("title,result", [("feat(cache): introduce redis cache", "Introduce Redis Cache"), ("chore:  bump   API deps", "Bump API Deps"), ("no colon", "No Colon"), ("x: élan vital", "Élan Vital"), ("x:", "")])
def test_commit_title(spark, title, result):
    assert one(spark, t.commit_title, title) == result


@pytest.mark.parametrize(
    "content,facts",
    [
        ("Auth Service uses Redis", [("Auth Service", "USES", "Redis")]),
        ("API Gateway depends on Auth Service", [("API Gateway", "DEPENDS_ON", "Auth Service")]),
        ("Billing stores data in PostgreSQL", [("Billing", "STORES_IN", "PostgreSQL")]),
        ("User Service calls Notification Service", [("User Service", "CALLS", "Notification Service")]),
        ("Auth Service USES Redis", [("Auth Service", "USES", "Redis")]),
        ("## **a** uses `b` and c calls d, also e uses f!", [("A", "USES", "B"), ("C", "CALLS", "D"), ("E", "USES", "F")]),
        ("a uses b\nuses c\n- x depends on y", [("A", "USES", "B"), ("X", "DEPENDS_ON", "Y")]),
        ("Use Redis", []), ("uses Redis", []), ("depends on auth", []), ("calls notifications", []), ("stores data in postgres", []), ("A DEPENDS_ON b", []), ("Improve reliability", []),
    ],
)
def test_facts(spark, content, facts):
    rows = extract.facts(spark.createDataFrame([source("adr", content=content)], SOURCE)).collect()
    assert sorted((r.subject, r.predicate, r.object) for r in rows) == sorted(facts)


def test_documents_give_decisions_but_no_facts(spark):
    rows = spark.createDataFrame([source("architecture_doc", "T", "A uses B"), source("adr", "U", "x", id="s2", status="Accepted"), source("commit", "feat: A uses B", id="s3")], SOURCE)
    assert extract.facts(rows).count() == 0
    assert {(r.title, r.status) for r in extract.decisions(rows).collect()} == {("T", "Proposed"), ("U", "Accepted")}
    assert [r.title for r in extract.events(rows).collect()] == ["A Uses B"]


def test_intents(spark):
    rows = spark.createDataFrame([source("commit", "fix: Improve the speed, reduce load."), source("adr", content="# 1. We optimize *all*\nnothing here", id="s2"), source("session", "improve", id="s3")], SOURCE)
    assert {r.description for r in extract.intents(rows).collect()} == {"Improve The Speed", "Reduce Load", "Optimize *all"} | set()


def test_segments(spark):
    assert one(spark, t.segments, "x and and and y BUT z; q\n\n!a") == ["x", "y", "z", "q", "a"]


@pytest.mark.parametrize("raw,who", [("Al B <a@b.c>", ("Al B", "a@b.c")), ("a@b.c", ("", "a@b.c")), ("Just Name", ("Just Name", "")), ("x y@z", ("x y@z", "")), ("", ("", ""))])
def test_author(spark, raw, who):
    assert tuple(one(spark, t.author, raw)) == who


def test_scores(spark):
    score = lambda field, term, weak=False: one(spark, lambda c: t.field_score(c, term, weak), field)
    assert [score("Redis", "redis"), score("Redis Cache", "redis"), score("the redis", "redis"), score("the redis", "redis", True), score("x", "redis"), score(None, "redis"), score("redis", " ")] == [100, 75, 50, 25, 0, 0, 0]
    assert [score("the redis", "redis*"), score("redis x", "redis*")] == [0, 75]
    assert one(spark, lambda c: t.topic_score(t.topic_tokens(F.lit("Login, TOKEN zzz")), c), "token login") == 20
    assert [one(spark, t.token_estimate, x) for x in ("", "a", "abcd", "abcde", "é")] == [0, 1, 1, 2, 1]
    assert sorted(one(spark, t.clean_words, "Add the new Redis-cache, redis!")) == ["cache", "redis"]
    assert one(spark, t.clean_words, "") == []


@pytest.mark.parametrize("text", ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.123456Z", "2024-01-02 03:04:05 +0000", "2024-01-02 03:04:05 +0000 +0000", "2024-01-02T03:04:05", "2024-01-02 03:04:05"])
def test_times(spark, text):
    assert str(one(spark, t.parse_time, text)).startswith("2024-01-02 03:04:05")


def test_bad_time(spark):
    assert one(spark, t.parse_time, "yesterday") is None
