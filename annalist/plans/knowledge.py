"""The knowledge tables over one data folder, each built on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import code, extract, link, ownership, search
from ..sources import adapters
from ..storage import fingerprint, kept, once

NODES = (
    ("region", "'region:' || CAST(r_regionkey AS STRING)", "DECISION"),
    ("nation", "'nation:' || CAST(n_nationkey AS STRING)", "FACT"),
    ("supplier", "'supplier:' || CAST(s_suppkey AS STRING)", "EXPERTISE"),
    ("customer", "'customer:' || CAST(c_custkey AS STRING)", "CONTRIBUTOR"),
    ("orders", "'order:' || CAST(o_orderkey AS STRING)", "EVENT"),
)
EDGES = (
    ("nation", "'region:' || CAST(n_regionkey AS STRING)", "'nation:' || CAST(n_nationkey AS STRING)", "HAS_NATION"),
    ("supplier", "'nation:' || CAST(s_nationkey AS STRING)", "'supplier:' || CAST(s_suppkey AS STRING)", "HAS_SUPPLIER"),
    ("customer", "'nation:' || CAST(c_nationkey AS STRING)", "'customer:' || CAST(c_custkey AS STRING)", "HAS_CUSTOMER"),
    ("orders", "'customer:' || CAST(o_custkey AS STRING)", "'order:' || CAST(o_orderkey AS STRING)", "HAS_ORDER"),
)
ENTITY = {
    "id": "'part:' || CAST(p_partkey AS STRING)",
    "entity_type": "CASE WHEN p_size <= 20 THEN 'function' WHEN p_size <= 40 THEN 'method' ELSE 'struct' END",
    "name": "'Fn' || CAST(p_partkey AS STRING)",
    "qualified_name": "'pkg/' || p_brand || '.Fn' || CAST(p_partkey AS STRING)",
    "package_path": "'pkg/' || p_brand",
    "module": "p_brand",
    "file_path": "'pkg/' || p_brand || '/' || p_type || CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END",
}


class Knowledge:
    """Extracted tables and the search index are written once to the shared folder and read from there, so a query parses no raw text
    that an earlier one has parsed.  Decisions keep their records' texts, which are read where they lie."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def _state(self) -> tuple:
        return fingerprint(self.spark, f"{self.sf_dir}/events.parquet", f"{self.sf_dir}/documents.parquet")

    def _once(self, name: str, build) -> DataFrame:
        return once(self.spark, self._state, name, build)

    def table(self, name: str) -> DataFrame:
        return adapters.read(self.spark, self.sf_dir, name)

    @cached_property
    def go_files(self) -> DataFrame:
        return adapters.go_files(self.spark, self.sf_dir)

    @cached_property
    def commits(self) -> DataFrame:
        return adapters.commits(self.spark, self.sf_dir)

    @cached_property
    def records(self) -> DataFrame:
        return adapters.records(self.spark, self.sf_dir)

    @cached_property
    def sources(self) -> DataFrame:
        return self.commits.unionByName(self.records)

    @cached_property
    def events(self) -> DataFrame:
        return self._once("events", lambda: extract.events(self.commits))

    @cached_property
    def decisions(self) -> DataFrame:
        return extract.decisions(self.records)

    @cached_property
    def facts(self) -> DataFrame:
        return self._once("facts", lambda: extract.facts(self.records))

    @cached_property
    def intents(self) -> DataFrame:
        return self._once("intents", lambda: extract.intents(self.sources))

    @cached_property
    def contributors(self) -> DataFrame:
        return self._once("contributors", lambda: ownership.contributors(self.sources))

    @cached_property
    def expertise(self) -> DataFrame:
        return self._once("expertise", lambda: ownership.expertise(self.sources, self.contributors, self.events, self.decisions, self.facts))

    @cached_property
    def domains(self) -> DataFrame:
        """(contributor_id, domain) of expertise: from its rows where they are written already, else from the sources."""
        if kept(self.spark, self._state, "expertise"):
            return self.expertise.select("contributor_id", "domain")
        return self._once("domains", lambda: ownership.domains(self.sources))

    @cached_property
    def index(self) -> search.Index:
        counted = self._once("index-documents", lambda: search.counted_words(search.search_documents(self.events, self.decisions, self.facts)))
        found = self._once("postings", lambda: search.postings(counted))
        return search.Index(search.listed(found, counted), search.statistics(counted))

    @cached_property
    def nodes(self) -> DataFrame:
        return self._union([self.table(t).selectExpr(f"{e} AS id", f"'{k}' AS node_type") for t, e, k in NODES])

    @cached_property
    def edges(self) -> DataFrame:
        return self._union([self.table(t).selectExpr(f"{a} AS from_id", f"{b} AS to_id", f"'{k}' AS edge_type") for t, a, b, k in EDGES])

    @cached_property
    def entities(self) -> DataFrame:
        return self.table("part").selectExpr(*[f"{e} AS {n}" for n, e in ENTITY.items()])

    @cached_property
    def relations(self) -> DataFrame:
        """A part calls the one on the next line of an order.  Keys are exchanged, ids made of them at the end."""
        line = self.table("lineitem")
        a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("a"))
        b = line.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("b"))
        pairs = a.join(b, ["l_orderkey", "n"]).select("a", "b").distinct()
        return pairs.selectExpr("'part:' || CAST(a AS STRING) AS from_id", "'part:' || CAST(b AS STRING) AS to_id", "'CALLS' AS relationship_type")

    @cached_property
    def expertise_rows(self) -> DataFrame:
        """expertise with its id."""
        return self.expertise.withColumn("id", text.sha_key("exp_", F.lit(adapters.REPO), "contributor_id", "domain"))

    @cached_property
    def bridge(self) -> DataFrame:
        """(relationship_type, memory_id, code_id, strategy): the code that decisions name."""
        memories = self.decisions.select(F.col("id").alias("memory_id"), F.lit("DECISION").alias("kind"), F.concat(F.lit("Fn"), F.expr("substr(source_id, 4)"), F.lit(" "), "title").alias("text"))
        return code.bridge(memories, self.entities).withColumn("relationship_type", F.lit("DECISION_REFERENCES_CODE"))

    @cached_property
    def stored_edges(self) -> DataFrame:
        return link.stored_edges(self.intents, self.decisions, self.events, self.facts)

    @cached_property
    def link_counts(self) -> DataFrame:
        """How many stored edges a memory has, by type and direction, counted without the edges."""
        return self._once("link-counts", lambda: link.link_counts(self.intents, self.decisions, self.events, self.facts))

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
