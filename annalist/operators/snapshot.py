"""The knowledge graph of the tables: nodes of six kinds, stored and derived edges, and views of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import graph, link

TOP_NODES = 200
#: The types of an edge's ends.
ENDS = {
    "INTENT_DRIVES_DECISION": ("INTENT", "DECISION"),
    "DECISION_RESULTS_IN_EVENT": ("DECISION", "EVENT"),
    "FACT_SUPPORTS_DECISION": ("FACT", "DECISION"),
    "CONTRIBUTOR_EXPERT_IN_DOMAIN": ("EXPERTISE", "CONTRIBUTOR"),
    "DECISION_DEPENDS_ON_DECISION": ("DECISION", "DECISION"),
    "FACT_SUPPORTS_FACT": ("FACT", "FACT"),
    "DOMAIN_RELATES_TO_DOMAIN": ("EXPERTISE", "EXPERTISE"),
}


def leading_to(kind: str) -> set[str]:
    """The types of nodes from which edges can lead to a node of a type, that type included."""
    found, size = {kind}, 0
    while len(found) > size:
        size = len(found)
        found |= {a for a, b in ENDS.values() if b in found}
    return found


def node_id(repository: Column, kind: Column | str, entity: Column | str) -> Column:
    return t.sha_key("nod_", repository, F.lit(kind) if isinstance(kind, str) else kind, entity)


def nodes(repository_id: str, decisions: DataFrame, facts: DataFrame, events: DataFrame, intents: DataFrame, contributors: DataFrame, expertise: DataFrame) -> DataFrame:
    """(id, repository_id, node_type, entity_id); every table has a column id."""
    repo = F.lit(repository_id)
    kinds = {"DECISION": decisions, "FACT": facts, "EVENT": events, "INTENT": intents, "CONTRIBUTOR": contributors, "EXPERTISE": expertise}
    return graph.union_all(rows.select(node_id(repo, kind, "id").alias("id"), repo.alias("repository_id"), F.lit(kind).alias("node_type"), F.col("id").alias("entity_id")) for kind, rows in kinds.items())


def edges(repository_id: str, decisions: DataFrame, facts: DataFrame, events: DataFrame, intents: DataFrame, contributors: DataFrame, expertise: DataFrame, stored: bool = True, derived: bool = True, towards: set[str] | None = None) -> DataFrame:
    """(id, from_node_id, to_node_id, edge_type, category, evidence): only between entities that exist; evidence is JSON.

    towards: the types of nodes that edges must end at; all, if None.
    """
    repo = F.lit(repository_id)
    parts = []

    def put(rows: DataFrame, a: str, b: str, kind: str, category: str, evidence: Column) -> None:
        if towards is not None and b not in towards:
            return
        ends = rows.select(node_id(repo, a, "from_id").alias("from_node_id"), node_id(repo, b, "to_id").alias("to_node_id"), F.lit(kind).alias("edge_type"), F.lit(category).alias("category"), F.to_json(evidence).alias("evidence"))
        parts.append(ends.withColumn("id", t.sha_key("edg_", repo, "from_node_id", "to_node_id", "edge_type")))

    if stored:
        told = F.struct(F.col("id").alias("relationship_id"), "relationship_type")
        put(link.intent_decision(intents, decisions), "INTENT", "DECISION", "INTENT_DRIVES_DECISION", "STORED", told)
        put(link.decision_event(decisions, events), "DECISION", "EVENT", "DECISION_RESULTS_IN_EVENT", "STORED", told)
        put(link.fact_decision(facts, decisions), "FACT", "DECISION", "FACT_SUPPORTS_DECISION", "STORED", told)
        known = expertise.join(contributors.select(F.col("id").alias("contributor_id")), "contributor_id", "left_semi")
        put(known.select(F.col("id").alias("from_id"), F.col("contributor_id").alias("to_id"), "domain"), "EXPERTISE", "CONTRIBUTOR", "CONTRIBUTOR_EXPERT_IN_DOMAIN", "STORED", F.struct(F.col("from_id").alias("expertise_id"), F.col("to_id").alias("contributor_id"), "domain"))
    if derived:
        put(link.decision_dependencies(decisions), "DECISION", "DECISION", "DECISION_DEPENDS_ON_DECISION", "DERIVED", F.struct(F.col("evidence").alias("match_type")))
        put(link.fact_support(facts), "FACT", "FACT", "FACT_SUPPORTS_FACT", "DERIVED", F.struct(F.col("name").alias("matched")))
        own = expertise.select("contributor_id", "domain", "id", "score")
        pairs = link.domain_pairs(expertise).join(own.toDF("contributor_id", "domain_a", "from_id", "score_a"), ["contributor_id", "domain_a"]).join(own.toDF("contributor_id", "domain_b", "to_id", "score_b"), ["contributor_id", "domain_b"])
        who = contributors.select(F.col("id").alias("contributor_id"), F.col("name").alias("contributor_name"), F.col("email").alias("contributor_email"))
        pairs = pairs.join(who, "contributor_id", "left").fillna("", ["contributor_name", "contributor_email"])
        put(pairs, "EXPERTISE", "EXPERTISE", "DOMAIN_RELATES_TO_DOMAIN", "DERIVED", F.struct("contributor_id", "contributor_name", "contributor_email", "domain_a", "score_a", "domain_b", "score_b"))
    return graph.union_all(parts).select("id", "from_node_id", "to_node_id", "edge_type", "category", "evidence")


def top_nodes(all_nodes: DataFrame, all_edges: DataFrame, most: int = TOP_NODES) -> DataFrame:
    """(id, node_type, entity_id, degree) of the best connected nodes, by degree, type and id."""
    degree = graph.degrees(all_edges.select(F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id")))
    rows = all_nodes.join(degree, "id", "left").select("id", "node_type", "entity_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    return rows.orderBy(F.desc("degree"), "node_type", "id").limit(most)


def induced(top: DataFrame, all_edges: DataFrame) -> DataFrame:
    """The edges with both ends among the top nodes, which TOP_NODES bounds."""
    ids = F.broadcast(top.select("id"))
    return all_edges.join(ids.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_semi").join(ids.withColumnRenamed("id", "to_node_id"), "to_node_id", "left_semi").orderBy("edge_type", "id")


def node_detail(all_edges: DataFrame, node: str) -> DataFrame:
    """(direction, id, other, edge_type, category) of the edges at a node."""
    into = all_edges.where(F.col("to_node_id") == node).select(F.lit("in").alias("direction"), "id", F.col("from_node_id").alias("other"), "edge_type", "category")
    out = all_edges.where(F.col("from_node_id") == node).select(F.lit("out").alias("direction"), "id", F.col("to_node_id").alias("other"), "edge_type", "category")
    return into.unionByName(out)


def filter_nodes(rows: DataFrame, kind: str = "", text: str = "") -> DataFrame:
    """Nodes of a type (or all) whose id, type or entity holds a text."""
    kind, text = kind.strip().upper(), text.strip().lower()
    if kind and kind != "ALL":
        rows = rows.where(F.col("node_type") == kind)
    return rows.where(F.lower(F.concat_ws(" ", "id", "node_type", "entity_id")).contains(text)) if text else rows


def suggested_questions(all_nodes: DataFrame | None, all_edges: DataFrame, least: int = 2) -> DataFrame:
    """(position, question) from the first hub and the first edge between types; fixed values: the sentences.

    Components come from the same edges, so no edge leads from one to another and types alone surprise.  Without nodes the types of an edge's
    ends are those of ENDS, as in edges of ``edges``, all of whose ends exist.
    """
    plain = all_edges.select(F.col("from_node_id").alias("from_id"), F.col("to_node_id").alias("to_id"), "edge_type")
    hub = graph.hubs(plain, least).agg(F.min(F.struct(-F.col("degree"), "id")).alias("h"))
    crossing = [kind for kind, (a, b) in ENDS.items() if a != b]
    found = plain.where(F.col("edge_type").isin(crossing)) if all_nodes is None else graph.surprises(plain, all_nodes)
    link_ = found.agg(F.min(F.struct("from_id", "to_id")).alias("s"))
    both = hub.join(F.broadcast(link_), how="cross")  # two rows of one
    asked = F.array_compact(F.array(F.format_string("Why is %s a hub in the knowledge graph?", F.col("h.id")), F.format_string("What links %s and %s across communities?", F.col("s.from_id"), F.col("s.to_id"))))
    first = F.when(F.col("h").isNotNull(), asked[0])
    second = F.when(F.col("s").isNotNull(), asked[1])
    listed = F.array_compact(F.array(first, second))
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("What are the main architectural decisions in this repository?")))
    return both.select(F.posexplode(listed).alias("position", "question")).select((F.col("position") + 1).alias("position"), "question")
