"""The commit source, tables that change together, and ownership kept up to date."""

import random
import shutil
import subprocess
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from annalist.operators import extract, ownership
from annalist.sources import commit_source
from annalist.streaming import ingest
from annalist.streaming import ownership as live
from annalist.streaming.tables import Tables

SOURCES = "id string, repository_id string, source_type string, reference string, title string, author string, ts timestamp_ntz, content string, status string"


@pytest.fixture
def repository(tmp_path):
    path = tmp_path / "repo"
    path.mkdir()

    def git(*arguments):
        done = subprocess.run(["git", "-c", "user.name=Al", "-c", "user.email=a@b.c", *arguments], cwd=path, check=True, capture_output=True, text=True)
        return done.stdout.strip()

    git("init", "-q", "-b", "main")

    def commit(message):
        git("commit", "-q", "--allow-empty", "-m", message)
        return git("rev-parse", "HEAD")

    return str(path), git, commit


def test_commit_batches(spark, repository):
    path, git, commit = repository
    read = lambda **o: {r.id: r.title for r in commit_source.commits(spark, path, "r", **o).collect()}
    assert read() == {}
    made = [commit(f"feat: add {n}\n\nbody {n}") for n in range(5)]
    assert read() == {c: f"feat: add {n}\n\nbody {n}" for n, c in enumerate(made)}
    assert set(read(since=made[1])) == set(made[2:]) and read(since=made[4]) == {} and set(read(since=made[0], until=made[2])) == set(made[1:3])
    assert set(read(since="0" * 40)) == set(made)  # unknown: all
    row = commit_source.commits(spark, path, "r", since=made[3]).first()
    assert (row.author, row.source_type, row.reference) == ("Al <a@b.c>", "commit", made[4]) and row.ts is not None
    for bad in ({"until": "nothing"}, {"until": "0" * 40}):
        with pytest.raises(Exception, match="no commit"):
            read(**bad)
    with pytest.raises(Exception, match="commit_log needs"):
        spark.read.format(commit_source.FORMAT).load().collect()


def test_commit_stream_reads_each_commit_once(spark, repository, tmp_path):
    """Restarted at each offset; nothing at an unchanged head; slices of two; rewritten history is read again and merges by id."""
    path, git, commit = repository
    seen = []

    def run():
        got = []
        stream = commit_source.commit_stream(spark, path, "r", size=2)
        stream.writeStream.foreachBatch(lambda rows, n: got.extend(r.id for r in rows.collect())).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        seen.extend(got)
        return got

    made = [commit("fix: zero")]
    assert run() == made
    for n in (1, 2, 5):
        new = [commit(f"fix: {n}.{k}") for k in range(n)]
        made += new
        assert sorted(run()) == sorted(new) and run() == []
    assert sorted(seen) == sorted(made)
    git("checkout", "-q", "--orphan", "fresh")
    other = commit("feat: begin anew")
    git("branch", "-q", "-D", "main")
    git("reflog", "expire", "--expire=now", "--all")
    git("gc", "-q", "--prune=now")
    assert run() == [other]


def test_stream_of_commits_into_tables(spark, repository, tmp_path):
    path, git, commit = repository
    tables = Tables(spark, str(tmp_path / "tables"), buckets=3)
    commit("feat: add login")
    for message in ("fix: repair sqlite query", "docs: tell"):
        ingest.ingest(commit_source.commit_stream(spark, path, "r"), tables, str(tmp_path / "c")).awaitTermination()
        commit(message)
    ingest.ingest(commit_source.commit_stream(spark, path, "r"), tables, str(tmp_path / "c")).awaitTermination()
    assert tables.read("sources").count() == 3 and tables.read("events").count() == 3 and live.contributors(tables.snapshot()).first().commit_count == 3
    number = tables.snapshot().number
    ingest.ingest(commit_source.commit_stream(spark, path, "r"), tables, str(tmp_path / "other")).awaitTermination()  # a replay from the start
    assert tables.read("sources").count() == 3 and tables.snapshot().number == number + 1


def test_changes_are_whole(spark, tmp_path):
    """A crash before the entry, inside the entry or after it: the table is the old or the new one, and nothing is lost."""
    tables = Tables(spark, str(tmp_path / "t"), buckets=4)
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id string, v string")
    now = lambda: sorted(r.id for r in tables.read("x").collect())
    assert tables.read("x") is None
    first = tables.change("s", 0)
    first.merge("x", rows("a", "b"))
    assert tables.read("x") is None
    first.commit()
    assert now() == ["a", "b"] and tables.change("s", 0) is None
    lost = tables.change("s", 1)
    lost.merge("x", rows("c"))
    lost.replace("x", lost.read("x").where("false"), [0, 1], "id")  # a crash here: no entry
    assert now() == ["a", "b"]
    again = tables.change("s", 1)
    again.merge("x", rows("c"))
    again.commit()
    assert now() == ["a", "b", "c"]
    (tmp_path / "t" / "_log" / "0000000002" / "_SUCCESS").unlink()  # a crash inside the entry
    assert now() == ["a", "b"]
    last = tables.change("s", 1)
    last.merge("x", rows("c", "a"), gone=spark.createDataFrame([("b",)], "id string"))
    last.commit()
    assert now() == ["a", "c"] and {r.id: (r.created_at, r.version) for r in tables.read("x").collect()} == {"a": (1, 2), "c": (2, 2)}
    with pytest.raises(RuntimeError):
        last.commit()
    empty = tables.change()
    empty.merge("x", rows().limit(0), gone=rows("a", "c"))
    empty.commit()
    assert now() == [] and tables.vacuum(1) >= 1 and now() == []
    shutil.rmtree(tmp_path / "t" / "_log")
    assert tables.read("x") is None


def test_small_change_leaves_other_buckets(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), buckets=8)
    change = tables.change()
    change.merge("x", spark.range(200).select(F.col("id").cast("string").alias("id")))
    change.commit()
    before = tables.snapshot().places
    change = tables.change()
    change.merge("x", spark.createDataFrame([("7",)], "id string"))
    change.commit()
    after = tables.snapshot().places
    assert len(before) == 8 and sum(before[k] != after[k] for k in before) == 1 and tables.read("x").count() == 200


WORDS = ["login token", "sqlite storage query", "context render", "agent tool", "pipeline deploy", "nothing"]


def a_source(rng, number):
    person = rng.choice(["Al <a@b.c>", "Albert <a@b.c>", "Bo <b@b.c>", "Cy", "", None])
    if rng.random() < 0.3:
        content = f"Module uses {rng.choice(WORDS)}. We reduce {rng.choice(WORDS)}."
        return (f"r{number}", "r", "adr", f"docs/{number}.md", f"Adopt {rng.choice(WORDS)}", person, None, content, "")
    kind = rng.choice(["feat", "fix", "docs", "wip"])
    return (f"c{number}", "r", "commit", f"c{number}", f"{kind}: {rng.choice(WORDS)} {number}", person, datetime(2024, 1, 1) + timedelta(days=rng.randint(0, 90)), None, None)


@pytest.mark.parametrize("seed", [2])
def test_ownership_equals_the_whole(spark, tmp_path, seed):
    """After each of a random sequence of batches (new, changed, moved and deleted sources): equal to computing it all, a falling best included."""
    rng = random.Random(seed)
    tables = Tables(spark, str(tmp_path / "t"), buckets=2)
    whole: dict[str, tuple] = {}
    for step in range(4):
        batch = {s[0]: s for s in (a_source(rng, rng.randint(0, 25)) for _ in range(12 if step == 0 else 5))}
        gone = [i for i in rng.sample(sorted(whole), min(len(whole), 3)) if i not in batch] if step else []
        if step == 3:  # the person who leads goes
            lead = [i for i, s in whole.items() if s[5] == "Bo <b@b.c>" and i not in batch]
            gone = sorted({*gone, *lead})
        whole |= batch
        whole = {i: s for i, s in whole.items() if i not in gone}
        change = tables.change("s", step)
        rows = spark.createDataFrame(list(batch.values()), SOURCES), spark.createDataFrame([(i,) for i in gone], "id string")
        (ingest.take if step < 2 else live.apply)(change, *rows)
        change.commit()
        sources = spark.createDataFrame(list(whole.values()), SOURCES)
        people = ownership.contributors(sources)
        now = tables.snapshot()
        rows = lambda df: sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
        assert rows(live.contributors(now)) == rows(people)
        assert rows(live.expertise(now)) == rows(ownership.expertise(sources, people, extract.events(sources), extract.decisions(sources), extract.facts(sources)))
        if step == 1:  # what earlier versions said is gone too
            assert {r.id for r in now.read("events").collect()} == {r.id for r in extract.events(sources).collect()}
            assert {r.id for r in now.read("facts").collect()} == {r.id for r in extract.facts(sources).collect()}


def test_ownership_touches_changed_people_alone(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"), buckets=16)
    sources = [(f"c{n}", "r", "commit", f"c{n}", f"feat: login {n}", f"P{n % 20} <p{n % 20}@b.c>", datetime(2024, 1, 1), None, None) for n in range(60)]
    change = tables.change()
    live.apply(change, spark.createDataFrame(sources, SOURCES))
    change.commit()
    before = tables.snapshot().places
    change = tables.change()
    assert len(live.apply(change, spark.createDataFrame([sources[3][:4] + ("feat: sqlite",) + sources[3][5:]], SOURCES))) == 1
    change.commit()
    after = tables.snapshot().places
    assert {n: sum(before.get(k) != after[k] for k in after if k[0] == n) for n in ("authors", "work", "people", "raw")} == {"authors": 1, "work": 1, "people": 1, "raw": 1}
