"""Full-text and field search over memories."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import B, K1, PRECEDENCE, TOP_CODE, TOP_TEXT, WEAK
from ..functions import text as t
from ..storage import cut
from .graph import union_all

# fixed values: what type: may name
TYPES = ("DECISION", "FACT", "EVENT", "INTENT", "CONTRIBUTOR", "EXPERTISE")


@dataclass(frozen=True)
class Query:
    """A parsed request: terms, and optional type and domain."""

    terms: tuple[str, ...] = field(default=())
    type: str = ""
    domain: str = ""


def parse_query(text: str) -> Query:
    terms, kind, domain = [], "", ""
    for word in text.split():
        name, colon, value = word.partition(":")
        if colon and name.lower() == "type":
            kind = value.upper()
            if kind not in TYPES:
                raise ValueError(f"unknown type {value!r}")
        elif colon and name.lower() == "domain":
            if not value:
                raise ValueError("domain: needs a value")
            domain = value
        else:
            terms.append(word)
    return Query(tuple(terms), kind, domain)


def search_documents(events: DataFrame, decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, entity_type, title, content) of what can be found; intents are not indexed."""
    # lines that begin with # fall out; then all blanks become one
    body = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"(?mdU)^[\s&&[^\n]]*#[^\n]*", ""), r"(?U)\s+", " ")
    return (
        events.select("id", F.lit("EVENT").alias("entity_type"), "title", F.concat_ws(" ", "description", "event_type").alias("content"))
        .unionByName(decisions.select("id", F.lit("DECISION").alias("entity_type"), "title", t.squeeze(F.concat_ws(" ", "status", body)).alias("content")))
        .unionByName(facts.select("id", F.lit("FACT").alias("entity_type"), F.col("subject").alias("title"), F.concat_ws(" ", "predicate", "object").alias("content")))
    )


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), "")


def query_words(text: str) -> list[str]:
    """A query's terms as the index cuts them: - and _ part words, other marks fall out."""
    import re

    kept = re.sub("[^a-z0-9_ ]", "", text.lower().replace("-", " "))
    return list(dict.fromkeys(kept.replace("_", " ").split()))


@dataclass(frozen=True)
class Index:
    """postings(word, id, entity_type, tf, length), in order of words within each file, so a prefix reads few pages; stats(n, mean) of all documents."""

    postings: DataFrame
    stats: DataFrame


def counted_words(documents: DataFrame) -> DataFrame:
    """documents with a number (doc) and length and words(word, tf) in place of title and content.

    A document's words are sorted and counted inside its row, so they are never exchanged.  The numbers hold for one evaluation: store the
    rows before anything refers to them.
    """
    kept = [c for c in documents.columns if c not in ("title", "content")]
    own = documents.select(*kept, F.sort_array(words(F.concat_ws(" ", "title", "content"))).alias("w"))
    size = F.size("w")
    last = F.filter(F.sequence(F.lit(1), size), lambda n: (n == size) | (F.get("w", n) != F.get("w", n - 1)))  # places where runs of a word end
    ends = own.select(*kept, size.alias("length"), "w", F.when(size > 0, last).otherwise(F.array().cast("array<int>")).alias("ends"))
    runs = F.transform("ends", lambda n, i: F.struct(F.get("w", n - 1).alias("word"), (n - F.coalesce(F.get("ends", i - 1), F.lit(0))).alias("tf")))
    return ends.select(F.monotonically_increasing_id().alias("doc"), *kept, "length", runs.alias("words"))


def postings(counted: DataFrame, *keys: str) -> DataFrame:
    """(keys, word, tf) of stored ``counted_words``, sorted where they lie: each file is a segment in order of words."""
    return counted.select(*(keys or ("doc",)), F.inline("words")).sortWithinPartitions("word", *(keys or ("doc",)))


def listed(found: DataFrame, counted: DataFrame, *keys: str) -> DataFrame:
    """postings with their documents' columns, as ``bm25`` takes them; a filter of words reaches the postings before the join."""
    return found.join(counted.drop("words"), list(keys or ("doc",)))


def statistics(counted: DataFrame) -> DataFrame:
    """(n, mean): documents and their mean length."""
    return counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))


def index_documents(documents: DataFrame) -> Index:
    counted = cut(counted_words(documents))
    return Index(listed(postings(counted), counted), statistics(counted))


def bm25(index: Index, query: str, entity_type: str = "", top: int = TOP_TEXT) -> DataFrame:
    """(id, rank) of the documents that hold a word with each term as prefix, best (most negative) first.

    Only the postings of the terms are read; the prefixes reach the scan as filters.
    """
    terms = query_words(query)
    if not terms:
        return index.postings.select("id", "entity_type", F.lit(0.0).alias("rank")).where("false")
    wanted = F.lit(False)
    for p in terms:
        wanted = wanted | F.col("word").startswith(p)
    keys = [c for c in ("segment", "doc") if c in index.postings.columns]  # rows come joined by these: no further exchange
    counted = index.postings.where(wanted).groupBy(*keys, "id", "entity_type", "length").agg(*[F.sum(F.when(F.col("word").startswith(p), F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, p in enumerate(terms)])
    found = counted.agg(*[F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))])
    stats = index.stats.join(F.broadcast(found), how="cross")  # one row
    hits = counted.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms))))
    if entity_type:
        hits = hits.where(F.col("entity_type") == entity_type)
    rank = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        tf = F.col(f"tf{i}")
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.join(F.broadcast(stats), how="cross").select("id", "entity_type", F.round(rank, 6).alias("rank")).orderBy("rank", "id").limit(top)


def text_hits(ranked: DataFrame) -> DataFrame:
    """Scores by place: 100 for a first hit far ahead, 75 for the first three, 50 for the rest.  The input has at most TOP_TEXT rows."""
    place = F.row_number().over(Window.orderBy("rank", "id"))
    score = F.when((F.col("place") == 1) & (F.col("rank") < -10), 100).when(F.col("place") <= 3, 75).otherwise(50)
    return ranked.withColumn("place", place).select("entity_type", F.col("id").alias("entity_id"), F.lit("memory").alias("source"), score.alias("score"))


def match_fields(rows: DataFrame, entity_type: str, source: str, fields: list[tuple[str, bool]], query: Query) -> DataFrame:
    """Best score of any term in any field; a type alone finds every row."""
    if query.type and query.type != entity_type:
        return rows.select(F.lit(entity_type).alias("entity_type"), F.col("id").alias("entity_id"), F.lit(source).alias("source"), F.lit(0).alias("score")).where("false")
    if not query.terms:
        score = F.lit(WEAK if query.type and not query.domain else 0)
    else:
        scores = [t.field_score(F.col(c), w, weak) for w in query.terms for c, weak in fields]
        score = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return rows.select(F.lit(entity_type).alias("entity_type"), F.col("id").alias("entity_id"), F.lit(source).alias("source"), score.cast("int").alias("score")).where("score > 0")


FIELDS = {
    "DECISION": [("id", False), ("title", False), ("status", True)],
    "FACT": [("subject", False), ("predicate", False), ("object", False), ("id", True)],
    "EVENT": [("id", False), ("description", False), ("title", True)],
    "INTENT": [("id", False), ("description", False)],
    "CONTRIBUTOR": [("name", False), ("email", False), ("id", True)],
    "EXPERTISE": [("domain", False), ("id", True)],
}


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit per entity: the highest score, then the source that ranks higher."""
    order = F.coalesce(*[F.when(F.col("source") == s, n) for s, n in PRECEDENCE.items()])
    best = hits.groupBy("entity_type", "entity_id").agg(F.max(F.struct("score", order.alias("precedence"), "source")).alias("b"))
    return best.select("entity_type", "entity_id", "b.score", "b.source")


def federated(tables: dict[str, DataFrame], index: Index | Callable[[], Index], query: Query, found: DataFrame | None = None) -> DataFrame:
    """Hits of all sources; only branches that the type and domain allow are built.

    index: the index, or what builds it, which is called only where the query searches texts.
    found: discovery's (entity_type, entity_id).  Its items are matched again over their rows' own fields, so they score as the memories
    do and rank behind them; they add hits only for entities that a table given here lacks.
    """
    branches = []
    if query.terms and query.type in ("", "DECISION", "FACT", "EVENT") and not query.domain:
        branches.append(text_hits(bm25(index() if callable(index) else index, " ".join(query.terms), query.type)))
    for kind, rows in tables.items():
        if query.domain and kind != "EXPERTISE":
            continue
        own = rows.where(F.contains(F.lower("domain"), F.lit(query.domain.lower()))) if query.domain else rows
        asked = Query(query.terms or (query.domain,), query.type) if query.domain else query
        branches.append(match_fields(own, kind, "ownership" if kind in ("CONTRIBUTOR", "EXPERTISE") else "memory", FIELDS[kind], asked))
        if found is not None and not query.domain and kind in ("DECISION", "FACT", "EVENT", "CONTRIBUTOR") and (query.terms or query.type):
            ids = found.where(F.col("entity_type") == kind).select(F.col("entity_id").alias("id"))
            branches.append(match_fields(rows.join(ids, "id", "left_semi"), kind, "discovery", FIELDS[kind], query))
    return best_hits(union_all(branches))


def code_search(entities: DataFrame, terms: list[str], top: int = TOP_CODE) -> DataFrame:
    """The best code entities by the sum of the terms' scores."""
    name, whole, path = F.lower("name"), F.lower("qualified_name"), F.lower("file_path")
    score = F.lit(0)
    for w in (x.lower() for x in terms):
        score = score + F.when((name == w) | (whole == w), 100).when(whole.endswith("." + w), 80).when(name.contains(w), 50).when(whole.contains(w), 40).when(path.contains(w), 25).otherwise(0)
    return entities.select("id", "entity_type", "qualified_name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "entity_type", "qualified_name", "id").limit(top)
