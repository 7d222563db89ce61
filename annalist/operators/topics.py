"""Topics: what memories and code a phrase is about, and the packages of answers that start from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .code import entity_role
from .search import code_search

# fixed values: how reusable a kind of code is, and a decision's rank behind all code
REUSE = {"function": 1, "method": 1, "struct": 2, "interface": 2, "type_alias": 3, "file": 4, "package": 5}
OTHER_CODE, DECISION_RANK = 6, 10


def normal_topic(text: str) -> str:
    return " ".join(text.split()).lower()


def topic_terms(topic: str) -> list[str]:
    """Its words of two bytes or more."""
    return [w for w in topic.split() if len(w.encode()) >= 2]


def expand(hits: DataFrame, bridge: DataFrame) -> DataFrame:
    """(node, first): the hits(node) and what links(relationship_type, memory_id, code_id) add to them in one pass in the links' order.

    A link is taken when an end is a hit or was added by an earlier link; both its ends are hits for later ones.  Every node keeps the least
    link that adds it (null for a hit), and rounds of joins lower it until no link is added, so there is no fold over all links.
    """
    at = F.struct("relationship_type", "memory_id", "code_id")
    links = bridge.select("memory_id", "code_id", at.alias("at"))
    first = cut(hits.select("node").distinct().withColumn("first", F.lit(None).cast(dict(links.dtypes)["at"])))
    size = -1
    while True:
        a = first.select(F.col("node").alias("memory_id"), F.lit(True).alias("has_a"), F.col("first").alias("a"))
        b = first.select(F.col("node").alias("code_id"), F.lit(True).alias("has_b"), F.col("first").alias("b"))
        near = links.join(a, "memory_id", "left").join(b, "code_id", "left")
        earlier = lambda has, when: F.col(has).isNotNull() & (F.col(when).isNull() | (F.col(when) < F.col("at")))
        taken = near.where(earlier("has_a", "a") | earlier("has_b", "b")).select("memory_id", "code_id", "at")
        added = taken.select(F.explode(F.array("memory_id", "code_id")).alias("node"), F.col("at").alias("first"))
        known = first.unionByName(added).groupBy("node").agg(F.max(F.col("first").isNull()).alias("hit"), F.min("first").alias("first"))
        first = cut(known.select("node", F.when(~F.col("hit"), F.col("first")).alias("first")))
        found = first.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "first").cast("decimal(38,0)"))).first()
        if found == size:
            return first
        size = found


def resolve_topic(topic: str, repository_hits: DataFrame, entities: DataFrame, bridge: DataFrame) -> DataFrame:
    """(side, id): memories and code that a topic is about: search hits(entity_id), the best code matches, and what the bridge adds."""
    code = code_search(entities, topic_terms(normal_topic(topic))).select(F.col("id").alias("node"))
    memory = repository_hits.select(F.col("entity_id").alias("node"))
    reached = expand(memory.union(code), bridge).select("node")
    linked = bridge.join(reached.withColumnRenamed("node", "memory_id"), "memory_id", "left_semi").join(reached.withColumnRenamed("node", "code_id"), "code_id", "left_semi")
    return (
        memory.union(linked.select("memory_id")).distinct().select(F.lit("repository").alias("side"), F.col("node").alias("id"))
        .unionByName(code.union(linked.select("code_id")).distinct().select(F.lit("code").alias("side"), F.col("node").alias("id")))
    )


def topic_class(resolved: DataFrame) -> DataFrame:
    """One row: mixed, code, repository or none, and the hits of either side."""
    count = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, 1)), F.lit(0)).alias
    counts = resolved.agg(count("repository")("repository_hits"), count("code")("code_hits"))
    kind = F.when((F.col("repository_hits") > 0) & (F.col("code_hits") > 0), "mixed").when(F.col("code_hits") > 0, "code").when(F.col("repository_hits") > 0, "repository").otherwise("none")
    return counts.select(kind.alias("primary_type"), "repository_hits", "code_hits")


def with_siblings(ids: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities of ids(id), and all of a file's where the file itself is among them."""
    own = entities.join(ids.select("id").distinct(), "id", "left_semi")
    files = own.where("entity_type = 'file'").select("file_path").distinct()
    return own.unionByName(entities.join(files, "file_path", "left_semi").select(*own.columns)).distinct()


def match_expertise(expertise: DataFrame, topic: str) -> DataFrame:
    """(kind, id, label, score): domains that hold a word of the topic, and their owners, each once with the best score."""
    low, wanted = F.lower("domain"), F.lit(False)
    for w in topic_terms(topic):
        wanted = wanted | low.contains(w)
    own = expertise.where(wanted)
    domains = own.select(F.lit("EXPERTISE").alias("kind"), "id", F.col("domain").alias("label"), "score")
    owners = own.groupBy("contributor_id").agg(F.max("score").alias("score")).select(F.lit("CONTRIBUTOR").alias("kind"), F.col("contributor_id").alias("id"), F.col("contributor_id").alias("label"), "score")
    return domains.unionByName(owners)


def ownership_answer(expertise: DataFrame, subject: str, most: int = 3) -> DataFrame:
    """One row (summary): the owners of matching domains, best score first, then by domain and contributor.  Fixed values: the sentences."""
    low, wanted = F.lower("domain"), F.lit(False)
    for w in topic_terms(normal_topic(subject)):
        wanted = wanted | low.contains(w)
    best = expertise.where(wanted).groupBy("contributor_id").agg(F.min(F.struct((-F.col("score")).alias("by"), "domain")).alias("b")).orderBy("b", "contributor_id").limit(most)
    listed = best.agg(F.array_sort(F.collect_list(F.struct("b", "contributor_id"))).alias("all"))
    lines = F.array_join(F.transform("all", lambda x: F.concat(F.lit("  - "), x["contributor_id"])), "\n")
    return listed.select(F.when(F.size("all") > 0, F.concat(F.lit(f'Primary owner candidates for "{subject}":\n'), lines)).otherwise(F.lit(f'No ownership evidence found for "{subject}".')).alias("summary"))


def reuse_candidates(code: DataFrame, decisions: DataFrame) -> DataFrame:
    """(rank, entity_type, label, defined_in, role) of what a task could reuse: code by kind, then decisions.

    code: entities; decisions: (id, title).  Fixed values: the ranks and a decision's role.
    """
    rank = F.coalesce(*[F.when(F.col("entity_type") == kind, n) for kind, n in REUSE.items()], F.lit(OTHER_CODE))
    role = entity_role(F.col("entity_type"), F.col("name"), F.col("package_path"))
    rows = code.select(rank.alias("rank"), "entity_type", F.col("qualified_name").alias("label"), F.col("file_path").alias("defined_in"), role.alias("role"))
    patterns = decisions.select(F.lit(DECISION_RANK).alias("rank"), F.lit("DECISION").alias("entity_type"), F.col("title").alias("label"), F.col("id").alias("defined_in"), F.lit("existing decision pattern").alias("role"))
    return rows.dropDuplicates(["label", "entity_type"]).unionByName(patterns.distinct())


def file_context(entities: DataFrame, path: str) -> DataFrame:
    """(entity_type, position, id, qualified_name, n): all that a file holds, by kind and name, and how many of the kind; a file that is not indexed
    has no rows."""
    from pyspark.sql import Window

    own = entities.where(F.col("file_path") == path)  # one file's entities
    kind = Window.partitionBy("entity_type")
    return own.select("entity_type", F.row_number().over(kind.orderBy("qualified_name", "id")).alias("position"), "id", "qualified_name", F.count(F.lit(1)).over(kind).alias("n"))


def ambiguous_names(entities: DataFrame, most: int = 5) -> DataFrame:
    """(name, n, candidates): short names of more than one entity, whatever the case, with the first qualified names.

    The candidates of a name are its few least qualified names, kept by a window whose limit is a literal.
    """
    from pyspark.sql import Window

    rows = entities.select(F.lower("name").alias("name"), "qualified_name").distinct()
    counts = entities.groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("qualified_name"))).where(F.col("_n") <= most)
    listed = place.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("qualified_name")), ",").alias("candidates"))
    return counts.join(listed, "name").select("name", "n", "candidates")


def onboarding(decisions: DataFrame, most: int = 10) -> DataFrame:
    """(position, id, title) of the first decisions by title."""
    rows = decisions.select("id", "title").orderBy("title", "id").limit(most).agg(F.array_sort(F.collect_list(F.struct("title", "id"))).alias("all"))
    return rows.select(F.posexplode("all").alias("position", "d")).select((F.col("position") + 1).alias("position"), "d.id", "d.title")


def review_guide(resolved: DataFrame, entities: DataFrame, known: DataFrame, expertise: DataFrame) -> DataFrame:
    """(section, entity_type, id, label): what a reviewer of a topic looks at: affected files and packages, related knowledge, needed expertise.

    resolved: (side, id) of ``resolve_topic``; known: (entity_id, entity_type, label) of ``readers.resolve``; expertise: of ``match_expertise``.
    """
    code = with_siblings(resolved.where("side = 'code'").select("id"), entities)
    areas = code.where("entity_type IN ('file', 'package')").select(F.lit("affected_areas").alias("section"), "entity_type", "id", F.col("qualified_name").alias("label"))
    memory = known.where("entity_type IN ('DECISION', 'FACT', 'EVENT')").select(F.lit("related_knowledge").alias("section"), "entity_type", F.col("entity_id").alias("id"), "label")
    named = known.where("entity_type = 'EXPERTISE'").select("entity_type", F.col("entity_id").alias("id"), "label")
    needed = named.unionByName(expertise.where("kind = 'EXPERTISE'").select(F.col("kind").alias("entity_type"), "id", "label")).distinct()
    return areas.unionByName(memory).unionByName(needed.select(F.lit("required_expertise").alias("section"), "*")).unionByName(named.select(F.lit("affected_areas").alias("section"), "*")).distinct()


def plan_steps(decisions: int, briefings: int, starts: list[str], most: int = 4) -> list[str]:
    """Numbered steps of a plan; fixed values: the sentences."""
    out = []
    if decisions:
        out.append("Review relevant decisions — they constrain implementation.")
    if briefings:
        out.append("Read entity_briefings for roles, defined_in, and relationships.")
    if starts:
        more = f" (+{len(starts) - most} more)" if len(starts) > most else ""
        out.append(f"Begin at starting points: {', '.join(starts[:most])}{more}.")
    out += ["Run analyze_topic_impact before broad refactors.", "Run review on the task topic before merge."]
    return [f"{n}. {text}" for n, text in enumerate(out, 1)]
