"""Registered queries over parsed source files, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import QUERIES
from .operators import calls, code, graph, paths
from .plans.knowledge import Knowledge
from .sources.adapters import GO_MODULE
from .storage import cut

#: The calls of ``adapters.GO_FILE``: (from, to, line) by the parts that a file's names stand for.
_SAME = "JOIN part b ON b.p_partkey = a.p_partkey + {n} AND b.p_brand = a.p_brand"
_FN = "'function:pkg/' || {t}.p_brand || '.Fn' || {t}.p_partkey"
_RUN = "'method:pkg/' || {t}.p_brand || '.T' || {t}.p_partkey || '.Run' || {t}.p_partkey"
GO_CALLS = (
    f"go_calls AS (SELECT {_RUN.format(t='a')} AS from_id, {_FN.format(t='b')} AS to_id, 13 AS line FROM part a {_SAME.format(n=1)}"
    f" UNION ALL SELECT {_RUN.format(t='a')}, {_FN.format(t='b')}, 13 FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 2 AND b.p_brand = 'Brand#' || (a.p_size % 5 + 1) || (a.p_size // 5 % 5 + 1)"
    f" UNION ALL SELECT {_FN.format(t='a')}, {_FN.format(t='b')}, 18 FROM part a {_SAME.format(n=3)}"
    f" UNION ALL SELECT {_FN.format(t='a')}, {_RUN.format(t='a')}, 19 FROM part a"
    f" UNION ALL SELECT {_FN.format(t='a')}, {_RUN.format(t='b')}, 21 FROM part a {_SAME.format(n=4)})"
)


def _parsed(k: Knowledge) -> tuple[DataFrame, DataFrame]:
    """(entities, call relations) of the parts' Go files."""
    entities = cut(code.parse_symbols(k.go_files).withColumn("id", F.concat("entity_type", F.lit(":"), "qualified_name")))  # parsed once, joined four times
    return entities, calls.resolve_call_sites(calls.call_sites(k.go_files), entities, GO_MODULE)


def parsed_calls(k: Knowledge) -> DataFrame:
    return _parsed(k)[1].select("from_id", "to_id", "line")


def parsed_call_graph(k: Knowledge) -> DataFrame:
    """The calls out of what no call leads to, to depth 10."""
    relations = cut(_parsed(k)[1])
    roots = relations.select(F.col("from_id").alias("id")).distinct().join(relations.select(F.col("to_id").alias("id")).distinct(), "id", "left_anti")
    return graph.call_graph(relations, roots)


_WALK = "walk AS (SELECT DISTINCT from_id AS id, 0 AS hops FROM go_calls WHERE from_id NOT IN (SELECT to_id FROM go_calls) UNION SELECT to_id, hops + 1 FROM walk JOIN go_calls ON from_id = walk.id WHERE hops < 9), near AS (SELECT id, min(hops) AS hops FROM walk GROUP BY 1)"
#: Orders lead from a part to the part on their next line: each line is an edge of its own, so parts that meet in two orders have two.
_LINE = "l_edges AS (SELECT 'line:' || a.l_orderkey || '-' || a.l_linenumber AS id, 'part:' || a.l_partkey AS from_id, 'part:' || b.l_partkey AS to_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"
_ENDS = "ends AS (SELECT 'part:' || p_partkey AS id FROM part WHERE p_brand = (SELECT p_brand FROM part WHERE p_partkey = 1))"


def ways_between(k: Knowledge) -> DataFrame:
    """In order, with their edges: all paths of up to three lines from the first part to the parts of its brand, which go no further from there."""
    line = k.table("lineitem")
    a = line.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"))
    b = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    part = lambda c: F.concat(F.lit("part:"), F.col(c).cast("string"))
    edges = a.join(b, ["l_orderkey", "l_linenumber"]).select(F.format_string("line:%d-%d", "l_orderkey", "l_linenumber").alias("id"), part("a").alias("from_id"), part("b").alias("to_id"))
    parts = k.table("part")
    ends = parts.join(parts.where("p_partkey = 1").select("p_brand"), "p_brand").select(part("p_partkey").alias("id"))
    found = paths.ordered(paths.simple_paths(edges, parts.where("p_partkey = 1").select(part("p_partkey").alias("id")), 3, ends=ends))
    return found.select("position", F.array_join("nodes", ">").alias("path"), F.array_join("edges", ">").alias("edge_ids"), "hops")


_WAYS = "ways AS (SELECT ['part:1'] AS nodes, CAST([] AS VARCHAR[]) AS edges, 0 AS hops UNION ALL SELECT list_append(w.nodes, e.to_id), list_append(w.edges, e.id), hops + 1 FROM ways w JOIN l_edges e ON e.from_id = w.nodes[-1] WHERE hops < 3 AND NOT list_contains(w.nodes, e.to_id) AND (hops = 0 OR w.nodes[-1] NOT IN (SELECT id FROM ends)))"
QUERIES["ways_between"] = (
    ways_between,
    f"WITH RECURSIVE {_LINE}, {_ENDS}, {_WAYS} SELECT CAST(row_number() OVER (ORDER BY hops, nodes[1], nodes[-1], edges) AS BIGINT) AS position, array_to_string(nodes, '>') AS path, array_to_string(edges, '>') AS edge_ids, hops FROM ways WHERE hops > 0 AND nodes[-1] IN (SELECT id FROM ends)",
)
QUERIES |= {
    "parsed_calls": (parsed_calls, f"WITH {GO_CALLS} SELECT * FROM go_calls"),
    "parsed_call_graph": (parsed_call_graph, f"WITH RECURSIVE {GO_CALLS}, {_WALK} SELECT from_id, to_id, hops FROM near JOIN go_calls ON from_id = near.id"),
}
