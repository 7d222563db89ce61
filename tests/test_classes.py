"""Links by word classes against their expanded pairs."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.operators import classes, graph


def sides(spark, seed, n, vocabulary, most):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = lambda mark: [(f"{mark}{i}", list(dict.fromkeys(rng.choices(vocabulary, weights, k=rng.randint(0, most))))) for i in range(n)]
    left, right = rows("l"), [*rows("r"), ("none", None), ("empty", [])]
    return left, right, *[spark.createDataFrame(x, "id string, words array<string>") for x in (left, right)]


def expanded(left, right):
    return {(a, b) for a, x in left for b, y in right if set(x or []) & set(y or [])}


@pytest.mark.parametrize("hot, most", [(3, 8), (3, 1), (0, 3)])
def test_degrees_equal_pairs(spark, hot, most):
    """All words cold, all hot, and both; sets counted by subsets and class by class."""
    left, right, a, b = sides(spark, hot, 60, [f"w{k}" for k in range(40)], 7)
    found = classes.links(a, F.col("words"), b, F.col("words"), hot)
    pairs = expanded(left, right)
    for side in (0, 1):
        got = {r.id: r.degree for r in classes.degrees(found, side, most).collect()}
        want = {}
        for p in pairs:
            want[p[side]] = want.get(p[side], 0) + 1
        assert got == want
    some = spark.createDataFrame([(f"l{i}",) for i in range(0, 60, 4)], "id string")
    asked = {r.id for r in some.collect()}
    assert {tuple(r) for r in classes.pairs_of(found, some, 0).collect()} == {p for p in pairs if p[0] in asked}
    assert {r.id for r in classes.step(found, some, 0).collect()} == {b for a, b in pairs if a in asked}
    back = spark.createDataFrame([("r1",), ("r2",), ("none",)], "id string")
    assert {tuple(r) for r in classes.pairs_of(found, back, 1).collect()} == {p for p in pairs if p[1] in ("r1", "r2")}


def test_components_equal_pairs(spark):
    left, right, a, b = sides(spark, 5, 40, [f"w{k}" for k in range(90)], 3)
    extra = [("l0", "r7"), ("x", "y")]
    edges = spark.createDataFrame(extra, "from_id string, to_id string")
    got = {r.id: r.component for r in classes.linked_components([classes.links(a, F.col("words"), b, F.col("words"), 2)], edges).collect()}
    pairs = spark.createDataFrame(sorted(expanded(left, right)) + extra, "from_id string, to_id string")
    assert got == {r.id: r.component for r in graph.components(pairs).collect()}


def test_a_word_that_all_titles_share(spark):
    """100,000 titles with one word in common: every table stays linear, and the degrees are right."""
    n = 50_000
    word = lambda mark: F.array(F.lit("all"), F.concat(F.lit("m"), (F.col("id") % 1000).cast("string")), F.concat(F.lit(mark), F.col("id").cast("string")))
    rows = lambda mark: spark.range(n).select("id", word(mark).alias("w")).select(F.concat(F.lit(mark), F.col("id").cast("string")).alias("id"), F.col("w").alias("words"))
    found = classes.links(rows("l"), F.col("words"), rows("r"), F.col("words"), hot=20)
    assert found.words.count() == 4 * n and found.members.count() == 2 * n and found.classes.count() == 2000 and found.cold.count() == 0
    assert [tuple(r) for r in classes.degrees(found, 0).select("degree").distinct().collect()] == [(n,)]
    found = classes.links(rows("l"), F.col("words"), rows("r"), F.col("words"), hot=64)  # m words are cold: their pairs share the hot word, so none is kept
    assert found.cold.count() == 0 and classes.degrees(found, 1).agg(F.sum("degree")).first()[0] == n * n


def test_members_are_exchanged_once_each(spark, monkeypatch):
    """Rows of one id are one member, and what is stored first has a row for each member instead of each word."""
    from annalist.operators import classes

    stored = []
    monkeypatch.setattr(classes, "cut", lambda df, cut=classes.cut: stored.append(cut(df)) or stored[-1])
    words = lambda rows: spark.createDataFrame(rows, "id string, w array<string>")
    found = classes.links(words([("a", ["x", "y", "x"]), ("a", ["y", "z"]), ("n", [])]), F.col("w"), words([("b", ["z", "y", "q", "r"])]), F.col("w"))
    assert stored[0].count() == 2
    assert sorted((r.side, r.id, r.word) for r in found.words.collect()) == [(0, "a", "y"), (0, "a", "z"), (1, "b", "y"), (1, "b", "z")]
    assert [r.degree for r in classes.degrees(found, 0).collect()] == [1]
