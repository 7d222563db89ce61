"""Paths with edges against a plain search."""

import random

import pytest

from annalist.operators import paths


def plain(edges, starts, depth, inbound=False, ends=None):
    """All simple paths as (nodes, edges)."""
    out, todo = [], [((s,), ()) for s in starts]
    while todo:
        nodes, used = todo.pop()
        if used and (ends is None or (nodes[0] if inbound else nodes[-1]) in ends):
            out.append((nodes, used))
            if ends is not None:
                continue
        if len(used) == depth:
            continue
        for e, a, b in edges:
            if inbound and b == nodes[0] and a not in nodes:
                todo.append(((a, *nodes), (e, *used)))
            elif not inbound and a == nodes[-1] and b not in nodes:
                todo.append(((*nodes, b), (*used, e)))
    return out


def graph_of(seed):
    rng = random.Random(seed)
    names = "abcdefg"
    return [(f"e{k}", rng.choice(names), rng.choice(names)) for k in range(14)]


@pytest.mark.parametrize("seed, inbound", [(1, False), (2, True)])
def test_paths_in_order(spark, seed, inbound):
    rows = graph_of(seed)
    edges = spark.createDataFrame(rows, "id string, from_id string, to_id string")
    starts = spark.createDataFrame([("a",), ("c",)], "id string")
    got = [(r.position, tuple(r.nodes), tuple(r.edges), r.hops) for r in paths.ordered(paths.simple_paths(edges, starts, 4, inbound)).orderBy("position").collect()]
    want = sorted(plain(rows, "ac", 4, inbound), key=lambda p: (len(p[1]), p[0][0], p[0][-1], p[1]))
    assert got == [(n, nodes, used, len(used)) for n, (nodes, used) in enumerate(want, 1)]


@pytest.mark.parametrize("seed", [3, 4])
def test_paths_between(spark, seed):
    """A start that is an end, ends out of reach, and ends on the way to others, where a path stops."""
    rows = graph_of(seed)
    edges = spark.createDataFrame(rows, "id string, from_id string, to_id string")
    for ends in ("g", "dx", "ab"):
        found = paths.simple_paths(edges, spark.createDataFrame([("a",)], "id string"), 4, ends=spark.createDataFrame([(e,) for e in ends], "id string"))
        assert sorted((tuple(r.nodes), tuple(r.edges)) for r in found.collect()) == sorted(plain(rows, "a", 4, ends=ends))


def test_nothing_grows_off_the_way(spark):
    """A start with many ways that lead nowhere: only the way to the end is grown."""
    rows = [(f"x{n}", "s", f"n{n}") for n in range(300)] + [(f"y{n}", f"n{n}", f"m{k}") for n in range(300) for k in range(3)] + [("u", "s", "t"), ("v", "t", "end"), ("w", "t", "end")]
    edges = spark.createDataFrame(rows, "id string, from_id string, to_id string")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    found = paths.ordered(paths.simple_paths(edges, one("s"), 3, ends=one("end"))).orderBy("position").collect()
    assert [(r.nodes, r.edges) for r in found] == [(["s", "t", "end"], ["u", "v"]), (["s", "t", "end"], ["u", "w"])]
    assert paths.simple_paths(edges, one("end"), 3, ends=one("s")).count() == 0


def test_order_of_paths_over_edges_of_one_name(spark):
    """Edges that share a name leave two paths alike but for a node between, which then orders them."""
    rows = [("e", "a", "x"), ("e", "a", "y"), ("f", "x", "z"), ("f", "y", "z")]
    edges = spark.createDataFrame(rows * 1, "id string, from_id string, to_id string")
    for parts in (1, 3):
        found = paths.ordered(paths.simple_paths(edges.repartition(parts), spark.createDataFrame([("a",)], "id string"), 2))
        assert [r.nodes[1] for r in found.where("hops = 2").orderBy("position").collect()] == ["y", "x"]
