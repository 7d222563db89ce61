"""Simple paths with their edges, in a fixed order, and paths between nodes that visit nothing off the way.

Edges are (id, from_id, to_id); parallel edges give distinct paths.  Between a start and some ends the search goes from both sides: a node is on the
way if its distance from the start and to an end fit into the depth together, and a path grows only where what is left of the depth reaches an
end.  Each hop is one join and a checkpoint.  Paths of a dense graph are exponential by definition; what is grown here is what is returned, and the
starts of such paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_DEPTH
from ..storage import cut
from .graph import reach, union_all
from .rank import numbered


def simple_paths(edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH, inbound: bool = False, ends: DataFrame | None = None) -> DataFrame:
    """(nodes, edges, hops) of all paths from starts(id) that visit no node twice, of 1 to depth edges.

    inbound: paths that end at a start.  ends(id): paths to one of these alone, which go no further from there.
    """
    here, there = ("to_id", "from_id") if inbound else ("from_id", "to_id")
    step = edges.select(F.col("id").alias("_edge"), F.col(here).alias("_at"), F.col(there).alias("_next"))
    if ends is not None:
        goal = cut(ends.select("id").distinct())
        plain = lambda a, b: step.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"))
        ahead = reach(plain("_at", "_next"), starts, depth - 1).select(F.col("id").alias("_at"), F.col("hops").alias("_from"))
        left = reach(plain("_next", "_at"), goal, depth - 1).select(F.col("id").alias("_next"), F.col("hops").alias("_left"))
        step = step.join(ahead, "_at").join(left, "_next").where(F.col("_from") + 1 + F.col("_left") <= depth)
        step = cut(step.join(goal.select(F.col("id").alias("_at")), "_at", "left_anti").unionByName(step.join(goal.select(F.col("id").alias("_at")), "_at", "left_semi").where("_from = 0")).select("_edge", "_at", "_next", "_left"))
    join = lambda new, old: F.concat(F.array(new), old) if inbound else F.concat(old, F.array(new))
    at = starts.select(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    found = []
    for hop in range(1, depth + 1):
        last = F.col("nodes")[0] if inbound else F.element_at("nodes", -1)
        grown = at.withColumn("_at", last).join(step, "_at").where(~F.array_contains("nodes", F.col("_next")))
        if ends is not None:
            grown = grown.where(F.col("_left") <= depth - hop)
        grown = cut(grown.select(join(F.col("_next"), F.col("nodes")).alias("nodes"), join(F.col("_edge"), F.col("edges")).alias("edges")))
        if grown.isEmpty():
            break
        rows = grown
        if ends is not None:
            reached = F.col("nodes")[0] if inbound else F.element_at("nodes", -1)
            marked = grown.withColumn("_end", reached).join(goal.select(F.col("id").alias("_end"), F.lit(True).alias("_done")), "_end", "left")
            rows, grown = marked.where("_done").select("nodes", "edges"), marked.where("_done IS NULL").select("nodes", "edges")
        found.append(rows.withColumn("hops", F.lit(hop)))
        at = grown
    return union_all(found) if found else starts.select(F.array("id").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.lit(0).alias("hops")).where("false")


def ordered(paths: DataFrame) -> DataFrame:
    """paths with their position: by length, first node, last node and edges; of paths over edges of the same names the greater nodes come first."""
    ends = paths.withColumn("_a", F.col("nodes")[0]).withColumn("_b", F.element_at("nodes", -1))
    return numbered(ends, "hops", "_a", "_b", "edges", F.desc("nodes")).drop("_a", "_b")
