import random

import pandas as pd
from pyspark.sql import functions as F

from annalist.operators import graph

EDGE = "from_id string, to_id string, edge_type string"


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "E") for a, b in pairs], EDGE)


def start(spark, name):
    return spark.createDataFrame([(name,)], "id string")


def paths(df):
    return sorted((r.hops, ">".join(r.nodes)) for r in df.collect())


def test_paths(spark):
    g = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "c"))
    assert paths(graph.simple_paths(g, start(spark, "a"))) == [(1, "a>b"), (1, "a>c"), (1, "a>c"), (2, "a>b>c")]
    assert paths(graph.simple_paths(g, start(spark, "a"), depth=1)) == [(1, "a>b"), (1, "a>c"), (1, "a>c")]
    assert paths(graph.simple_paths(g, start(spark, "c"), inbound=True)) == [(1, "a>c"), (1, "a>c"), (1, "b>c"), (2, "a>b>c")]
    assert paths(graph.path_between(g, start(spark, "b"), F.lit("a"))) == [(2, "b>c>a")]
    assert paths(graph.simple_paths(g, start(spark, "z"))) == []
    assert paths(graph.simple_paths(g.where("false"), start(spark, "a"))) == []


def test_reach_and_plan(spark):
    g = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("e", "a"))
    assert {r.id: r.hops for r in graph.reach(g, start(spark, "a")).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    nodes = spark.createDataFrame([("a", "DECISION"), ("b", "FACT"), ("c", "INTENT"), ("d", "EVENT"), ("e", "DECISION")], "id string, node_type string")
    assert {(r.entity_type, r.entity_id, r.priority) for r in graph.change_plan(graph.reach(g, start(spark, "a")), nodes).collect()} == {("FACT", "b", 1), ("EVENT", "d", 2), ("DECISION", "e", 3)}
    report = {r.end_id: r.reason for r in graph.impact_report(graph.simple_paths(g, start(spark, "a"), 1), nodes).collect()}
    assert report["b"] == "DECISION a impacts FACT b through traversal path."
    assert {(r.from_id, r.to_id) for r in graph.surprises(g, nodes).collect()} == {(r.from_id, r.to_id) for r in g.collect()} - {("e", "a")}


def test_call_graph_goes_to_depth_10(spark):
    """A walk as the reference's: breadth first, edges out of every node at 0 to 9 hops, also those back to seen nodes."""
    rng = random.Random(2)
    calls = {(f"c{i:02d}", f"c{i + 1:02d}") for i in range(14)} | {(f"c{i:02d}", f"c{rng.randint(0, i):02d}") for i in range(14)} | {("c02", "x"), ("x", "y")}
    distance, queue = {"c00": 0}, ["c00"]
    for at in queue:
        for a, b in sorted(calls):
            if a == at and b not in distance:
                distance[b] = distance[at] + 1
                queue.append(b)
    want = {(a, b, distance[a]) for a, b in calls if distance.get(a, 10) < 10}
    relations = spark.createDataFrame([(a, b, "CALLS") for a, b in calls] + [("c00", "z", "IMPORTS")], "from_id string, to_id string, relationship_type string")
    rows = graph.call_graph(relations, start(spark, "c00")).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert max(r.hops for r in rows) == 9 and "c10" not in {r.from_id for r in rows}


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randint(0, 160):03d}", f"n{rng.randint(0, 160):03d}") for _ in range(110)] + [(f"x{i:03d}", f"x{i + 1:03d}") for i in range(40)]
    up = {x: x for p in pairs for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    found = graph.components(edges(spark, *pairs))
    assert {r.id: r.component for r in found.collect()} == {x: find(x) for x in linked}
    assert found.count() == len(linked)
    ids = graph.with_component_ids(found, "r").collect()
    assert sum(r.size for r in ids) == len(linked) and all(r.component_id.startswith("com_") and len(r.component_id) == 20 for r in ids)
    assert graph.components(edges(spark, ("a", "a"))).count() == 0


def test_degrees(spark):
    g = edges(spark, ("a", "b"), ("a", "c"))
    assert {r.id: r.degree for r in graph.degrees(g).collect()} == {"a": 2, "b": 1, "c": 1}
    assert [r.id for r in graph.hubs(g).collect()] == ["a"]


def test_budgeted_walk(spark):
    frame = pd.DataFrame([("e1", "i", "d1"), ("e2", "d1", "d2")], columns=["id", "from_id", "to_id"])
    nodes, taken, used = graph.budgeted_walk(frame, {"i": 10, "d1": 10, "d2": 10}, {"e1": 5, "e2": 5}, "i", 50)
    assert nodes == ["i", "d1", "d2"] and taken == ["e1", "e2"] and used == 40
    assert graph.budgeted_walk(frame, {"i": 10, "d1": 10, "d2": 10}, {"e1": 5, "e2": 5}, "i", 26)[0] == ["i", "d1"]
    assert graph.budgeted_walk(frame, {"i": 99}, {}, "i", 50) == ([], [], 0)
    rows = spark.createDataFrame([("r", "e1", "i", "d1", 1, 1, 1), ("r", "e2", "d1", "d2", 1, 1, 1)], "repository_id string, id string, from_id string, to_id string, from_cost int, to_cost int, cost int")
    walked = graph.budgeted_walks(rows, spark.createDataFrame([("r", "i")], "repository_id string, start string"), 9)
    assert [r.node_id for r in walked.orderBy("position").collect()] == ["i", "d1", "d2"]


def test_quarantine(spark):
    good, bad = graph.require(spark.createDataFrame([("a", "b"), ("", "b"), (None, "b")], "x string, y string"), "x", "y")
    assert (good.count(), bad.count()) == (1, 2)


def test_whole_call_graph_of_the_tables(spark):
    """No edge out of a node at 3 to 9 hops is missing."""
    from collections import defaultdict

    import __spark_entry__ as entry
    from annalist.plans.knowledge import Knowledge

    sf = "/root/testdata/sf0.001"
    out = defaultdict(set)
    for r in Knowledge(spark, sf).relations.collect():
        out[r.from_id].add(r.to_id)
    distance, queue = {"part:1": 0}, ["part:1"]
    for at in queue:
        for b in out[at]:
            if b not in distance:
                distance[b] = distance[at] + 1
                queue.append(b)
    want = {(a, b, distance[a]) for a in queue if distance[a] < 10 for b in out[a]}
    assert {tuple(r) for r in entry.queries()["call_graph"](spark, sf).collect()} == want


def test_reach_reads_its_edges_once(spark):
    """However many hops it takes, what the edges are made from is computed once."""
    from pyspark.sql import functions as F

    from annalist.operators import graph

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(8)], "from_id string, to_id string").mapInArrow(counted, "from_id string, to_id string")
    start = spark.createDataFrame([("n0",)], "id string")
    assert {(r.id, r.hops) for r in graph.reach(chain, start, 5).collect()} == {(f"n{i}", i) for i in range(6)} and seen.value == 8
    found = graph.call_graph(chain.withColumn("relationship_type", F.lit("CALLS")), start).collect()
    assert len(found) == 8 and seen.value == 16
