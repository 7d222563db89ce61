"""Graph operators over edges(from_id, to_id, edge_type): paths, components, impact, plans.

Paths are grown one hop at a time, each hop one join; after each hop the frontier is checkpointed, so the plan
stays small and a lost executor costs one hop.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_DEPTH
from ..storage import cut

#: Nodes that a hop of ``reach`` may broadcast.
SMALL_FRONT = 100_000


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH, inbound: bool = False) -> DataFrame:
    """(nodes, hops) of all paths from starts(id) that visit no node twice, of 1 to depth edges; inbound paths end at the start."""
    step = edges.select(F.col("to_id" if inbound else "from_id").alias("_at"), F.col("from_id" if inbound else "to_id").alias("_next"))
    at = starts.select(F.array("id").alias("nodes"))
    out = None
    for hop in range(1, depth + 1):
        end = F.col("nodes")[0] if inbound else F.element_at("nodes", -1)
        grown = at.withColumn("_at", end).join(step, "_at").where(~F.array_contains("nodes", F.col("_next")))
        grown = cut(grown.select((F.concat(F.array("_next"), "nodes") if inbound else F.concat("nodes", F.array("_next"))).alias("nodes")))
        if grown.isEmpty():
            break
        rows = grown.withColumn("hops", F.lit(hop))
        out = rows if out is None else out.unionByName(rows)
        at = grown
    return out if out is not None else starts.select(F.array("id").alias("nodes"), F.lit(0).alias("hops")).where("false")


def path_counts(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, paths): how many simple paths of 1 to depth edges leave each start."""
    parts = path_parts(edges, starts, depth)
    return parts.join(starts.select("id"), "id", "left_semi").groupBy("id").agg(F.sum("paths").alias("paths"))


def path_parts(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, paths) that add up to ``path_counts``; nodes that are no starts may have rows too.

    Nodes on no cycle within reach of one are counted without listing a path: walks from a node are its edges and its neighbours' shorter
    walks, one join and aggregate a hop, and none of them visits a node twice.  Paths are listed only from starts that reach a cycle.
    """
    step = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("_next"))
    # edges to nodes without an edge out, mostly nearly all, end every path: they count in the first hop and are never exchanged again
    inner = cut(step.join(step.select(F.col("id").alias("_next")).distinct(), "_next", "left_semi").select("id", "_next"))
    core = cut(inner.distinct())  # what is left after nodes without an edge out are taken off again and again holds all cycles
    size = core.count()
    for _ in range(depth + 1):
        core = cut(core.join(core.select(F.col("id").alias("_next")).distinct(), "_next", "left_semi").select("id", "_next"))
        left = core.count()
        if left == size:
            break
        size = left
    cyclic = core.select("id").distinct()  # all that reach a cycle, or a chain of more than depth edges, which listing counts too
    counts, total = None, None
    for _ in range(depth):
        again = step if counts is None else inner.join(counts.withColumnsRenamed({"id": "_next", "n": "_n"}), "_next")
        counts = cut(again.groupBy("id").agg((F.count(F.lit(1)) if counts is None else F.sum("_n")).cast("long").alias("n")).join(cyclic, "id", "left_anti"))
        if counts.isEmpty():
            break
        total = counts if total is None else total.unionByName(counts)
    free = total.select("id", F.col("n").alias("paths")) if total is not None else starts.select("id", F.lit(0).cast("long").alias("paths")).where("false")
    if size == 0:
        return free
    listed = simple_paths(edges, starts.select("id").join(cyclic, "id", "left_semi"), depth)
    return free.unionByName(listed.groupBy(F.col("nodes")[0].alias("id")).agg(F.count(F.lit(1)).alias("paths")))


def reach(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH, stored: bool = False) -> DataFrame:
    """(id, hops): the nodes within depth edges and their least distance, starts at 0.  Visits a node once, so dense graphs cost no more.

    The edges are stored once (stored: they are already) and read again at each hop; a front of up to SMALL_FRONT nodes is broadcast to them, so
    only what it leads to is exchanged.
    """
    step = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("_next"))
    step = step if stored else cut(step)
    seen = cut(starts.select("id").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, depth + 1):
        size = front.count()
        if not size:
            break
        near = F.broadcast(front.select("id")) if size <= SMALL_FRONT else front.select("id")
        grown = step.join(near, "id").select(F.col("_next").alias("id")).distinct()
        front = cut(grown.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def call_graph(relations: DataFrame, roots: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(from_id, to_id, hops): all CALLS edges out of the nodes less than depth edges from roots(id), with that node's distance."""
    calls = cut(relations.where("relationship_type = 'CALLS'").select("from_id", "to_id"))
    near = reach(calls, roots, depth - 1, stored=True).withColumnRenamed("id", "from_id")
    return near.join(calls, "from_id").select("from_id", "to_id", "hops")


def path_between(edges: DataFrame, start: DataFrame, end: Column, depth: int = MAX_DEPTH) -> DataFrame:
    return simple_paths(edges, start, depth).where(F.element_at("nodes", -1) == end)


def ends(edges: DataFrame) -> DataFrame:
    """(id): both ends of each edge."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): both ends count."""
    return ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, least: int = 2) -> DataFrame:
    return degrees(edges).where(F.col("degree") >= least)


def surprises(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends differ in type; dangling edges fall out."""
    a = nodes.select(F.col("id").alias("from_id"), F.col("node_type").alias("from_type"))
    b = nodes.select(F.col("id").alias("to_id"), F.col("node_type").alias("to_type"))
    return edges.join(a, "from_id").join(b, "to_id").where("from_type <> to_type").select("from_id", "to_id", "edge_type", "from_type", "to_type")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, by rounds of star contraction until nothing changes."""
    links = cut(edges.select(F.greatest("from_id", "to_id").alias("a"), F.least("from_id", "to_id").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        links = cut(down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        found = links.agg(F.count(F.lit(1)), F.countDistinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark and found[0] == found[1]:
            break
        mark = found
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def with_component_ids(members: DataFrame, repository_id: str) -> DataFrame:
    """(component_id, size) with the hashed id of each component's sorted members, which stream by in order: no component is held."""
    schema = "component_id string, size long"

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, digest, size, out, last = None, None, 0, [], None
        for batch in batches:
            for component, node in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if component != now or digest is None:
                    if digest is not None:
                        out.append((f"com_{digest.hexdigest()[:16]}", size))
                    now, digest, size, last = component, hashlib.sha256(repository_id.encode()), 0, None
                if node != last:
                    digest.update(b"\0" + node.encode())
                    size, last = size + 1, node
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["component_id", "size"])
            out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([f"com_{digest.hexdigest()[:16]}"]), pa.array([size])], ["component_id", "size"])

    return members.select("component", "id").repartition("component").sortWithinPartitions("component", "id").mapInArrow(run, schema)


def reason(start_type: Column, start: Column, end_type: Column, end: Column) -> Column:
    """Why the start of a path affects its end."""
    # fixed values: the sentences
    say = lambda pattern, *parts: F.format_string(pattern, *parts)
    cases = {
        ("DECISION", "DECISION"): say("Decision %s impacts Decision %s because Decision %s depends on Decision %s.", start, end, end, start),
        ("FACT", "FACT"): say("Fact %s impacts Fact %s because Fact %s is supported by Fact %s.", start, end, end, start),
        ("CONTRIBUTOR", "EXPERTISE"): say("Contributor %s impacts Domain %s because repository expertise connects the contributor to the domain.", start, end),
        ("EXPERTISE", "CONTRIBUTOR"): say("Contributor %s impacts Domain %s because repository expertise connects the contributor to the domain.", end, start),
        ("DECISION", "EVENT"): say("Decision %s impacts Event %s because Event %s results from Decision %s.", start, end, end, start),
        ("FACT", "DECISION"): say("Fact %s impacts Decision %s because Decision %s is supported by Fact %s.", start, end, end, start),
        ("INTENT", "DECISION"): say("Intent %s impacts Decision %s because Decision %s is driven by Intent %s.", start, end, end, start),
    }
    out = say("%s %s impacts %s %s through traversal path.", start_type, start, end_type, end)
    for (a, b), text in cases.items():
        out = F.when((start_type == a) & (end_type == b), text).otherwise(out)
    return out


def impact_report(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths with their ends' types and the reason."""
    ends = paths.withColumn("start_id", F.col("nodes")[0]).withColumn("end_id", F.element_at("nodes", -1))
    a = nodes.select(F.col("id").alias("start_id"), F.col("node_type").alias("start_type"))
    b = nodes.select(F.col("id").alias("end_id"), F.col("node_type").alias("end_type"))
    both = ends.join(a, "start_id").join(b, "end_id")
    return both.select("start_id", "end_id", "hops", "nodes", reason(F.col("start_type"), F.col("start_id"), F.col("end_type"), F.col("end_id")).alias("reason"))


def change_plan(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a change touches, by distance: 1 direct, 2 one hop further, 3 beyond.  The least distance over simple paths is the graph distance."""
    kinds = ("DECISION", "FACT", "EVENT", "CONTRIBUTOR")
    rows = reached.where("hops > 0").join(nodes.where(F.col("node_type").isin(*kinds)), "id")
    return rows.select(F.col("node_type").alias("entity_type"), F.col("id").alias("entity_id"), F.least("hops", F.lit(3)).alias("priority"))


def contributor_plan(edges: DataFrame, nodes: DataFrame, start: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(entity_type, entity_id, priority) along the paths that end at start(id): nodes behind a path's first, so those with an edge in from
    another node of the way; the shortest such path has one edge."""
    back = cut(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")).where("from_id <> to_id"))
    near = reach(back, start, depth - 1, stored=True).select("id")  # whoever leads there within depth edges
    entered = near.join(back.select(F.col("from_id").alias("id")).distinct(), "id", "left_semi")
    return entered.join(nodes.where("node_type IN ('DECISION', 'FACT', 'EVENT', 'CONTRIBUTOR')"), "id").select(F.col("node_type").alias("entity_type"), "entity_id", F.lit(1).alias("priority"))


def budgeted_walk(edges: pd.DataFrame, costs: dict[str, int], edge_costs: dict[str, int], start: str, budget: int, compat: bool = False) -> tuple[list[str], list[str], int]:
    """Breadth-first, edges in id order, skipping what no longer fits: (nodes, edges, tokens used).

    edges: columns id, from_id, to_id of one repository's neighbourhood.  Each edge is paid once; with compat it is paid again
    from its other end.
    """
    if costs.get(start, 0) > budget:
        return [], [], 0
    around: dict[str, list[tuple[str, str]]] = {}
    for e in edges.sort_values("id").itertuples():
        around.setdefault(e.from_id, []).append((e.id, e.to_id))
        around.setdefault(e.to_id, []).append((e.id, e.from_id))
    nodes, taken, used, queue, paid = [start], [], costs.get(start, 0), deque([start]), set()
    seen = {start}
    while queue:
        here = queue.popleft()
        for edge, other in around.get(here, ()):
            if edge in paid and not compat:
                continue
            extra = edge_costs.get(edge, 0) + (0 if other in seen else costs.get(other, 0))
            if used + extra > budget:
                continue
            used += extra
            paid.add(edge), taken.append(edge)
            if other not in seen:
                seen.add(other), nodes.append(other), queue.append(other)
    return nodes, taken, used


def budgeted_walks(edges: DataFrame, starts: DataFrame, budget: int, by: str = "repository_id") -> DataFrame:
    """One walk per group: (group, node_id, position).  edges also carry from_cost, to_cost and cost; starts: (group, start)."""

    def walk(key, own: pd.DataFrame) -> pd.DataFrame:
        costs = dict(zip([*own.from_id, *own.to_id], [*own.from_cost, *own.to_cost], strict=True))
        nodes, _, _ = budgeted_walk(own, costs, dict(zip(own.id, own.cost, strict=True)), own.start.iloc[0], budget)
        return pd.DataFrame({by: [key[0]] * len(nodes), "node_id": nodes, "position": range(1, len(nodes) + 1)})

    kind = dict(edges.dtypes)[by]
    return edges.join(starts, by).groupBy(by).applyInPandas(walk, f"{by} {kind}, node_id string, position int")


def require(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose columns are all non-empty, the others)."""
    good = F.lit(True)
    for c in columns:
        good = good & F.coalesce(F.col(c) != "", F.lit(False))
    return rows.where(good), rows.where(~good)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out
