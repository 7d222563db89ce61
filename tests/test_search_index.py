"""The index of segments against one built anew."""

import random

from pyspark.sql import functions as F

from annalist.operators import search
from annalist.streaming import search_index
from annalist.streaming.tables import Tables

DOCUMENT = "repository_id string, id string, entity_type string, title string, content string"
WORDS = "add login token sqlite storage query render agent tool pipeline".split()


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT)


def test_search_equals_a_rebuilt_index(spark, tmp_path):
    """After each of a random sequence of inserts, updates and deletes in two repositories."""
    rng = random.Random(3)
    tables, whole = Tables(spark, str(tmp_path / "t")), {}
    for step in range(5):
        batch = {}
        for _ in range(14 if step == 0 else 3):
            key = (rng.choice("rs"), f"d{rng.randint(0, 30)}")
            batch[key] = (*key, rng.choice(["EVENT", "FACT"]), " ".join(rng.choices(WORDS, k=3)), " ".join(rng.choices(WORDS, k=rng.randint(0, 9))))
        gone = [x for x in rng.sample(sorted(whole), min(len(whole), 2)) if x not in batch]
        whole = {x: d for x, d in (whole | batch).items() if x not in gone}
        change = tables.change()
        search_index.apply(change, documents(spark, list(batch.values())), spark.createDataFrame(gone, "repository_id string, id string"))
        change.commit()
    now = tables.snapshot()
    assert sum(search_index.sizes(now).values()) >= len(whole) and len(search_index.sizes(now)) <= 6
    for repository in ("r", "s", None):
        own = [d for d in whole.values() if repository in (None, d[0])]
        fresh = search.index_documents(documents(spark, [(d[0], d[0] + d[1], *d[2:]) for d in own]))
        live = search_index.index(now, repository)
        live = search.Index(live.postings.withColumn("id", F.concat("repository_id", "id")), live.stats)
        for query in ("login", "s to", "agent pipe"):
            rows = lambda index: [tuple(r) for r in search.bm25(index, query).collect()]  # noqa: E731, B023
            assert rows(live) == rows(fresh)


def test_small_batches_leave_large_segments(spark, tmp_path):
    """Segments merge by tiers; a deleted document is gone at once and falls out when its segment merges; a rebuild leaves other repositories alone."""
    tables = Tables(spark, str(tmp_path / "t"))

    def take(rows, gone=(), whole=None):
        change = tables.change()
        if whole:
            search_index.rebuild(change, whole, documents(spark, rows))
        else:
            search_index.apply(change, documents(spark, rows), spark.createDataFrame(list(gone), "repository_id string, id string"))
        change.commit()

    document = lambda n, r="r": (r, f"d{n}", "EVENT", f"add {n}", "login")
    take([document(n) for n in range(100)])
    first = tables.snapshot().places[("postings", 1)]
    for n in range(4):
        take([document(200 + n)], [("r", f"d{n}")])
    now = tables.snapshot()
    assert now.places[("postings", 1)] == first and sorted(search_index.sizes(now).values()) == [4, 100]
    assert now.read("deleted").count() == 4 and search_index.index(now).stats.first().n == 100
    found = {r.id for r in search.bm25(search_index.index(now), "add", top=1000).collect()}
    assert found == {f"d{n}" for n in [*range(4, 100), *range(200, 204)]}
    take([document(7, "s")])
    take([document(1), document(2)], whole="r")
    now = tables.snapshot()
    assert search_index.index(now, "r").stats.first().n == 2 and search_index.index(now, "s").stats.first().n == 1
    assert search_index.index(Tables(spark, str(tmp_path / "none")).snapshot()) is None


def test_postings_hold_numbers(spark, tmp_path):
    """A segment's postings name documents by number; ids lie once, in its list of documents, also after a merge."""
    tables = Tables(spark, str(tmp_path / "t"))
    for n in range(4):
        change = tables.change()
        search_index.apply(change, documents(spark, [("r", f"d{n}", "EVENT", "add add", f"login {n}")]))
        change.commit()
    now = tables.snapshot()
    assert now.read("postings").columns == ["segment", "doc", "word", "tf"] and len(search_index.sizes(now)) == 1
    assert sorted((r.id, r.word, r.tf) for r in search_index.index(now).postings.where("word = 'add'").collect()) == [(f"d{n}", "add", 2) for n in range(4)]
