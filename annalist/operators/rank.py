"""Ranked reports: discovery, reviewers, features, authors, learning paths, compression."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DOMAIN_KEYWORDS
from ..functions import text as t
from ..storage import cut
from .graph import union_all

#: Rows that a task of ``numbered`` sorts, and below which a sort isn't spread over all cores.
RANGE_ROWS, LEAST_ROWS = 250_000, 10_000


def discovery(nodes: DataFrame, degrees: DataFrame, path_counts: DataFrame, expertise: DataFrame) -> DataFrame:
    """(entity_type, entity_id, score): relations and impact paths of memories; expertise and distinct domains of contributors.

    degrees(id, degree) and path_counts(id, paths) may have several rows for a node, which add up, and rows of other nodes.  All meet in one
    aggregate, which holds numbers for each id, instead of joins that sort every side.
    """
    kinds = ("DECISION", "FACT", "EVENT")
    part = lambda rows, score, of=None: rows.select("id", *[(F.when(F.col("node_type") == k, 1).otherwise(0) if of else F.lit(0)).cast("long").alias(k) for k in kinds], F.coalesce(score, F.lit(0)).cast("long").alias("score"))
    rows = union_all([part(nodes.where(F.col("node_type").isin(*kinds)), F.lit(0), True), part(degrees, F.col("degree")), part(path_counts, F.col("paths"))])
    found = rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in (*kinds, "score")])
    types = F.flatten(F.array(*[F.array_repeat(F.lit(k), F.col(k).cast("int")) for k in kinds]))  # one, or one for each row of a node
    memory = found.select("id", "score", F.explode(types).alias("node_type"))
    people = expertise.groupBy("contributor_id").agg((F.count(F.lit(1)) + F.countDistinct("domain")).cast("double").alias("score"))
    return memory.select(F.col("node_type").alias("entity_type"), F.col("id").alias("entity_id"), F.col("score").cast("double").alias("score")).unionByName(
        people.select(F.lit("CONTRIBUTOR").alias("entity_type"), F.col("contributor_id").alias("entity_id"), "score")
    )


def repository_reviewers(contributors: DataFrame, expertise: DataFrame, found: DataFrame) -> DataFrame:
    """Expertise, distinct domains and discovery score of each contributor, above 0."""
    own = expertise.groupBy("contributor_id").agg(F.count(F.lit(1)).alias("areas"), F.countDistinct("domain").alias("domains"))
    seen = found.where("entity_type = 'CONTRIBUTOR'").select(F.col("entity_id").alias("contributor_id"), F.col("score").alias("discovery"))
    rows = contributors.select(F.col("id").alias("contributor_id")).join(own, "contributor_id", "left").join(seen, "contributor_id", "left").fillna(0)
    return rows.select("contributor_id", (F.col("areas") + F.col("domains") + F.col("discovery")).alias("score")).where("score > 0")


def domain_reviewers(expertise: DataFrame, domain: str, authored: DataFrame, found: DataFrame) -> DataFrame:
    """Scores in the domain plus discovery scores of relevant items that a contributor authored; authored: (contributor_id, entity_id)."""
    return domain_scores(expertise, domain, authored.join(found.select("entity_id", "score"), "entity_id").groupBy("contributor_id").agg(F.sum("score").alias("items")))


def domain_scores(expertise: DataFrame, domain: str, items: DataFrame) -> DataFrame:
    """``domain_reviewers`` of items that are summed already: (contributor_id, items)."""
    own = expertise.where(F.lower("domain") == domain.lower()).groupBy("contributor_id").agg(F.sum("score").alias("expertise"))
    rows = own.join(items, "contributor_id", "full").fillna(0.0)
    return rows.select("contributor_id", F.round(F.col("expertise") + F.col("items"), 6).alias("score")).where("score > 0")


def impact_reviewers(touched: DataFrame, expertise: DataFrame, found: DataFrame) -> DataFrame:
    """Impacted items authored, their discovery scores, and matching expertise; touched: (contributor_id, entity_id, domains)."""
    items = touched.join(found.select("entity_id", F.col("score").alias("discovery")), "entity_id", "left")
    by_item = items.groupBy("contributor_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("discovery", F.lit(0.0))).alias("discovery"))
    match = touched.select("contributor_id", "entity_id", F.explode("domains").alias("domain")).join(expertise.select("contributor_id", "domain", "score"), ["contributor_id", "domain"]).groupBy("contributor_id").agg(F.sum("score").alias("fit"))
    rows = by_item.join(match, "contributor_id", "left").fillna(0.0, ["fit"])
    return rows.select("contributor_id", F.round(F.col("n") + F.col("discovery") + F.col("fit"), 6).alias("score"))


def _features(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """(name, keywords, sources, event_count): the fixed domains and each introduced feature, merged by lower-cased name; the first one's words count."""
    spark = events.sparkSession
    seed = spark.createDataFrame([(d, list(words)) for d, words in DOMAIN_KEYWORDS.items()], "name string, keywords array<string>").select("name", "keywords", F.lit("expertise_domain").alias("source"), F.lit(0).alias("n"), F.lit(0).alias("rank"))
    parts = F.array_distinct(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    introduced = events.where("event_type = 'FEATURE_INTRODUCED'").select(t.squeeze(F.col("title")).alias("name")).where("name <> ''").select("name", parts.alias("keywords"), F.lit("feature_event").alias("source"), F.lit(1).alias("n"), F.lit(1).alias("rank"))
    low = F.lower("title")
    none = F.array().cast("array<string>")
    named = decisions.select(F.coalesce(*[F.when(low.contains(d.lower()), d) for d in sorted(DOMAIN_KEYWORDS)]).alias("name")).where("name IS NOT NULL").select("name", none.alias("keywords"), F.lit("decision").alias("source"), F.lit(0).alias("n"), F.lit(2).alias("rank"))
    rows = seed.unionByName(introduced).unionByName(named)
    first = F.struct("rank", "name")
    return rows.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", first).alias("name"), F.min_by("keywords", first).alias("keywords"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.sum("n").alias("event_count")).drop("key")


def features(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """(name, sources, event_count) of ``_features``."""
    return _features(events, decisions).select("name", "sources", "event_count")


# fixed values: what equal and contained names and keywords add; the least score of a match, and of one that answers a single word by itself
EQUAL_NAME, HELD_NAME, EQUAL_WORD, HELD_WORD, LEAST_MATCH, LEAST_ALONE = 10, 6, 5, 2, 2, 8


def feature_score(name: Column, keywords: tuple[str, ...] | Column, topic: str) -> Column:
    """The sum of 10 for an equal name, 6 where one holds the other, and of each keyword 5 if equal and 2 if the topic holds it; empty keywords add nothing."""
    low, wanted = F.lower(name), F.lit(topic.strip().lower())
    points = lambda test, n: F.when(test, n).otherwise(0)
    words = F.array(*[F.lit(k) for k in keywords]) if isinstance(keywords, tuple) else keywords
    of_name = points(low == wanted, EQUAL_NAME) + points(F.contains(low, wanted) | F.contains(wanted, low), HELD_NAME)
    return of_name + F.aggregate(F.transform(words, F.lower), F.lit(0), lambda a, k: a + F.when(k == "", 0).otherwise(points(k == wanted, EQUAL_WORD) + points(F.contains(wanted, k), HELD_WORD)))


def feature_matches(events: DataFrame, decisions: DataFrame, topic: str) -> DataFrame:
    """(name, score, best, explains): the features that match a topic, which of them is the best (of equal ones the first by name), and whether
    one answers the topic by itself: by its very name, or a topic of one word that scores enough.  An empty topic matches none."""
    wanted = topic.strip().lower()
    rows = _features(events, decisions).select("name", feature_score(F.col("name"), F.col("keywords"), topic).alias("score")).where(F.lit(wanted != "") & (F.col("score") >= LEAST_MATCH))
    best = rows.agg(F.min_by("name", F.struct(-F.col("score"), F.lower("name"))).alias("_best"))  # one row
    explains = (F.lower("name") == wanted) | (F.lit(" " not in wanted) & (F.col("score") >= LEAST_ALONE))
    return rows.join(F.broadcast(best), how="cross").select("name", "score", (F.col("name") == F.col("_best")).alias("best"), explains.alias("explains"))


def author_evidence(sources: DataFrame, terms: list[str]) -> DataFrame:
    """(author, score): terms found in title, reference and content, summed by author."""
    text = F.lower(F.concat_ws(" ", "title", "reference", "content"))
    score = sum((F.when(F.contains(text, F.lit(w.lower())), 1).otherwise(0) for w in terms), F.lit(0))
    who = F.coalesce(F.nullif(t.squeeze(F.col("author")), F.lit("")), F.lit("unknown"))
    return sources.select(who.alias("author"), score.cast("long").alias("score")).where("score > 0").groupBy("author").agg(F.sum("score").alias("score"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "position", stored: bool = False) -> DataFrame:
    """rows with their place in a total order, from 1: sorted by ranges, counted by range, and numbered inside each.

    No window without a key: each range is numbered by its own task and starts after those before it, whose counts (a row per range)
    are summed on the driver.  There are as many ranges as keep each near RANGE_ROWS, so the memory of a task doesn't grow with the table.
    stored: rows are cheap to read again, as of stored tables; otherwise they are stored first.
    """
    rows = rows if stored else cut(rows)
    size = rows.count()
    ranges = max(-(-size // RANGE_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_ROWS)), 1)
    at = cut(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    before, total = [], 0
    for r in at.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("_n").alias("first")).orderBy("_range").collect():
        before.append((r["_range"], total - r["first"] + 1))
        total += r.n
    base = rows.sparkSession.createDataFrame(pa.table({"_range": pa.array([r for r, _ in before], pa.int32()), "_base": pa.array([b for _, b in before], pa.int64())}))
    return at.join(F.broadcast(base), "_range").withColumn(name, F.col("_n") + F.col("_base")).drop("_range", "_n", "_base")


def learning_rows(found: DataFrame, order: tuple[str, ...] = ("DECISION", "FACT", "EVENT", "CONTRIBUTOR")) -> DataFrame:
    """Discovery with its type's place in a fixed order (bucket): the rows of a learning path, which go by bucket, best score and id, without their places."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("entity_type")).cast("int")
    return found.withColumn("bucket", rank).where("bucket > 0")


def learning_path(found: DataFrame, order: tuple[str, ...] = ("DECISION", "FACT", "EVENT", "CONTRIBUTOR")) -> DataFrame:
    """Discovery, which the caller has stored, by type in a fixed order, numbered."""
    return numbered(learning_rows(found, order), "bucket", F.desc("score"), "entity_id", stored=True).select("position", "entity_type", "entity_id", "score")


def compress_rank(items: DataFrame, topic: str) -> DataFrame:
    """items(kind, id, text) with topic score and token cost."""
    tokens = t.topic_tokens(F.lit(topic))
    return items.select("kind", "id", "text", t.topic_score(tokens, F.col("text")).alias("score"), t.token_estimate(F.col("text")).alias("cost"))


def compress_pack(ranked: DataFrame, budget: int) -> DataFrame:
    """Takes items by score and text while they fit, skipping those that don't.

    A budget of n tokens takes at most n items that cost something, and an item that is cheaper than all before it in the
    order is never skipped for one behind it; so the fold needs only the first ``budget`` items of each cost.  Costs above the budget fall out.
    """
    if budget <= 0:
        return ranked.where("false")
    order = [F.desc("score"), F.col("text"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("cost").orderBy(*order))
    near = ranked.where((F.col("cost") <= budget) & (F.col("cost") > 0)).withColumn("_n", place).where(F.col("_n") <= budget)  # a literal limit: each task keeps no more
    near = near.where(F.col("_n") <= F.floor(F.lit(budget) / F.col("cost")))
    free = ranked.where("cost = 0")
    listed = near.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "text", "id", "kind", "cost"))).alias("all"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"))
    fold = F.aggregate("all", start, lambda a, x: F.when(a["used"] + x["cost"] <= budget, F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a))
    taken = listed.select(F.explode(fold["ids"]).alias("id"))
    return near.drop("_n").join(taken, "id", "left_semi").select(*ranked.columns).unionByName(free)


def relation_boost(scores: dict[str, int], edges: list[tuple[str, str]]) -> dict[str, int]:
    """Half of either end's score goes to the other, edge after edge in the given order (bounded by the request's items)."""
    out = dict(scores)
    for a, b in edges:
        if out.get(a, 0) > 0:
            out[b] = out.get(b, 0) + out[a] // 2
        if out.get(b, 0) > 0:
            out[a] = out.get(a, 0) + out[b] // 2
    return out


def access_ranking(items: DataFrame) -> DataFrame:
    """Last accessed first, never accessed last; then by count and id: numbered in one sort by ranges, so a repository may span tasks."""
    at = numbered(items, "repository_id", F.desc_nulls_last("last_accessed"), F.desc("access_count"), "id", name="_p")
    first = at.groupBy("repository_id").agg(F.min("_p").alias("_first"))
    return at.join(first, "repository_id").withColumn("position", (F.col("_p") - F.col("_first") + 1).cast("int")).drop("_p", "_first")
