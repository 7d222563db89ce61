import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.llm import near_duplicates as nd
from annalist.llm.common import stored
from tests.llm.conftest import prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, (ia, x)), (b, (ib, y)) in combinations(enumerate(sets), 2):
        if ia is not None and ib is not None and (x and y and 100 * len(x & y) >= 75 * len(x | y) or ia == ib):
            up[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(sets)), key=str)


def noisy(rng, words, share):
    return " ".join(w if rng.random() > share else f"n{rng.randint(0, 10**9)}" for w in words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(5, 260))]
        rows += [noisy(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05])) for _ in range(rng.randint(1, 7))]
    base = [rng.choice(words) for _ in range(120)]
    rows += [noisy(rng, base, 0.015) for _ in range(90)]
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) + " " + passage for _ in range(60)]
    rows += [rows[0]] * 5 + ["a b", "A  b", "a b c", None, "", "  "]
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_equals_brute_force(spark, corpus):
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in corpus], "doc_id long, text string, key int, hub int").repartition(5)
    assert result(nd.near_duplicates(rows)) == brute(corpus)


def test_odd_rows(docs, empty):
    got = result(nd.near_duplicates(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert nd.near_duplicates(empty).count() == 0


def test_one_component_for_each_doc_id(spark):
    """Rows of one doc_id are one document, also where one of them is empty."""
    t, u, v = prose(1), prose(9), prose(20)
    rows = [(3, t), (15, t), (15, u), (20, u), (21, v), (21, None), (22, v + " more"), (23, None), (15, "")]
    got = result(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows) and {c for i, _, c in got if i in (3, 15, 20)} == {3} and (21, 0, 21) in got


def test_large_groups_are_dealt_in_blocks(spark, corpus):
    """Blocks of 16 members find the same components."""
    rows = spark.createDataFrame(corpus, "doc_id long, text string")
    described = stored(nd.describe(rows), "d")
    firsts = stored(described.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("bits").alias("bits")), "f")
    groups = stored(nd.groups(rows, np.zeros(0, np.uint64)), "g")
    members = stored(nd.refine(groups, firsts, block=16), "m")
    few = result(nd.components(nd.tree_links(rows, members, firsts, block=16)).toDF("doc_id", "component_id").selectExpr("doc_id", "0 AS n_shingles", "component_id"))
    many = result(nd.components(nd.tree_links(rows, members, firsts)).toDF("doc_id", "component_id").selectExpr("doc_id", "0 AS n_shingles", "component_id"))
    assert few == many and len(few) > 90
    assert groups.count() > members.count()


def test_prefixes_share_a_shingle():
    rng = np.random.default_rng(2)
    for _ in range(300):
        both = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
        n = len(both)
        a = np.sort(rng.choice(both, rng.integers(3, n), replace=False))
        b = np.sort(rng.choice(both, rng.integers(3, n), replace=False))
        heavy = np.sort(rng.choice(both, rng.integers(0, n), replace=False))
        if nd.linked(a, b):
            pa, pb = (x[nd.prefixes(x, np.array([len(x)]), heavy)] for x in (a, b))
            assert len(np.intersect1d(pa, pb))


def test_tree_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 200), dtype=np.uint64)) for _ in range(12)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(0, 12)]
        sets.append(np.unique(np.concatenate((s[rng.random(len(s)) > rng.choice([0.02, 0.1, 0.2])], rng.integers(0, 1 << 63, 3, dtype=np.uint64)))))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        if nd.linked(sets[i], sets[j]):
            up[max(find(i), find(j))] = min(find(i), find(j))
    keys = np.arange(len(sets))
    links = dict(nd.group_links(keys, sets))
    groups = lambda f: sorted(sorted(i for i in range(len(sets)) if f(i) == r) for r in {f(i) for i in range(len(sets))})
    assert groups(find) == groups(lambda i: links.get(i, i))
