import os

from pyspark.sql import functions as F

from annalist import storage
from annalist.sources import files
from annalist.streaming import ingest


def test_upsert_keeps_created_at(spark):
    old = spark.createDataFrame([("a", "x", "t0", 1), ("b", "y", "t0", 1)], "id string, v string, created_at string, version int")
    new = spark.createDataFrame([("a", "z", "t1", 2), ("a", "w", "t1", 3), ("c", "q", "t1", 1)], "id string, v string, created_at string, version int")
    assert {(r.id, r.v, r.created_at) for r in storage.upsert(old, new).collect()} == {("a", "w", "t0"), ("b", "y", "t0"), ("c", "q", "t1")}
    assert {(r.id, r.v) for r in storage.insert_absent(old, new).collect()} >= {("a", "x"), ("b", "y")}
    assert storage.insert_absent(old, new).count() == 3


def test_replace_modules(spark):
    entities = spark.createDataFrame([("1", "m"), ("2", "n")], "id string, module string")
    relations = spark.createDataFrame([("1", "2"), ("2", "2")], "from_id string, to_id string")
    e, r = storage.replace_modules(entities, relations, spark.createDataFrame([("m",)], "module string"), spark.createDataFrame([("3", "m")], "id string, module string"), relations.where("false"))
    assert {x.id for x in e.collect()} == {"2", "3"} and [(x.from_id, x.to_id) for x in r.collect()] == [("2", "2")]


def test_replace_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], "x int, repository_id string"), path)
    storage.replace_partition(spark.createDataFrame([(3, "a")], "x int, repository_id string"), path)
    assert {(r.x, r.repository_id) for r in spark.read.parquet(path).collect()} == {(3, "a"), (2, "b")}


LOG = "h1\nAl <a@b.c>\n2024-01-02T03:04:05Z\nfeat: add x\n\nbody\0h2\nBo <b@b.c>\n2024-01-03T03:04:05Z\nfix: improve y\0short\0"


def test_commit_log(spark, tmp_path):
    (tmp_path / "log").write_text(LOG)
    rows = {r.id: r for r in files.commit_log(spark, str(tmp_path / "log"), "r").collect()}
    assert set(rows) == {"h1", "h2"} and rows["h1"].title == "feat: add x\n\nbody" and str(rows["h2"].ts) == "2024-01-03 03:04:05"


def test_markdown(spark, tmp_path):
    folder = tmp_path / "docs" / "adr" / "sub"
    os.makedirs(folder)
    (folder / "1.md").write_text("# One\n\n## Status\n\nSuperseded\n\ntext")
    (folder / "2.MD").write_text("# Two\nStatus: Draft\n")
    (folder / "3.md").write_text("no title")
    (folder / "4.txt").write_text("# no")
    rows = {r.reference: (r.title, r.status) for r in files.markdown_records(spark, str(tmp_path), "docs/adr", "adr", "r").collect()}
    assert rows == {"docs/adr/sub/1.md": ("One", "Superseded"), "docs/adr/sub/2.MD": ("Two", "Draft"), "docs/adr/sub/3.md": ("", "Accepted")}
    assert files.record_folders([("./docs/adr/", ""), ("x", "adr")])[:2] == [("docs/adr", "adr"), ("x", "adr")] and len(files.record_folders()) == 7


def test_source_tree(spark, tmp_path):
    for name, text in {"a/x.go": "package a", "vendor/y.go": "package y", "a/z.go": "// Code generated by x\npackage a"}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [r.path for r in files.source_tree(spark, str(tmp_path)).collect()] == ["a/x.go"]


def test_stream_is_idempotent(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "1").write_text(LOG)
    tables = ingest.Tables(spark, str(tmp_path / "tables"))
    assert ingest.keys_seen(tables).count() == 0
    for checkpoint in ("c1", "c1", "c2"):  # a second run over the same files, then a replay of all
        ingest.ingest(ingest.commit_stream(spark, str(logs), "r"), tables, str(tmp_path / checkpoint)).awaitTermination()
        assert {r.id for r in ingest.keys_seen(tables).collect()} == {"h1", "h2"}
        assert tables.read("events").count() == 2 and tables.read("intents").count() == 1
    (logs / "2").write_text("h3\nAl <a@b.c>\n2024-02-02T03:04:05Z\ndocs: tell\0")
    ingest.ingest(ingest.commit_stream(spark, str(logs), "r"), tables, str(tmp_path / "c1")).awaitTermination()
    assert tables.read("sources").count() == 3 and tables.read("events").count() == 3


def test_running_contributors(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "1").write_text(LOG)
    query = ingest.running_contributors(ingest.commit_stream(spark, str(logs), "r")).writeStream.outputMode("complete").format("memory").queryName("people").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("people").agg(F.sum("commit_count")).first()[0] == 2
