"""Lookups, lists and secondary-key scans of the knowledge and code tables, in the orders that answers rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: The order of each code table's lists; memories are listed by id.
ORDERS = {
    "entities": ("package_path", "entity_type", "qualified_name", "id"),
    "relations": ("relationship_type", "from_id", "to_id"),
    "bridge": ("relationship_type", "memory_id", "code_id"),
    "expertise": ("contributor_id", "domain"),
}


def by_id(rows: DataFrame, key: str, column: str = "id") -> DataFrame:
    """At most one row; the equality reaches the scan."""
    return rows.where(F.col(column) == key).limit(1)


def get(rows: DataFrame, key: str, column: str = "id") -> Row:
    """The row of an id; a missing one is an error."""
    found = by_id(rows, key, column).head()
    if found is None:
        raise LookupError(f"{key!r} not found")
    return found


def of_repository(rows: DataFrame, repository_id: str | None = None, *order: str) -> DataFrame:
    """All rows of a repository (or of all, without one), ordered where an order is given."""
    own = rows.where(F.col("repository_id") == repository_id) if repository_id is not None else rows
    return own.orderBy(*order) if order else own


def find(rows: DataFrame, table: str, **keys: str) -> DataFrame:
    """Rows whose columns equal the keys, in the table's order."""
    for column, value in keys.items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(*[c for c in ORDERS[table] if c in rows.columns])


def resolve(ids: DataFrame, decisions: DataFrame, facts: DataFrame, events: DataFrame, expertise: DataFrame) -> DataFrame:
    """(entity_id, entity_type, label) of ids(id): the first table that holds an id, in the order decision, fact, event, expertise.

    One join of all tables' narrow rows with the ids instead of a lookup per id and table.
    """
    kinds = (
        decisions.select("id", F.lit(1).alias("rank"), F.lit("DECISION").alias("entity_type"), F.col("title").alias("label"))
        .unionByName(facts.select("id", F.lit(2).alias("rank"), F.lit("FACT").alias("entity_type"), F.trim(F.concat_ws(" ", "subject", "predicate", "object")).alias("label")))
        .unionByName(events.select("id", F.lit(3).alias("rank"), F.lit("EVENT").alias("entity_type"), F.col("title").alias("label")))
        .unionByName(expertise.select("id", F.lit(4).alias("rank"), F.lit("EXPERTISE").alias("entity_type"), F.col("domain").alias("label")))
    )
    found = kinds.join(ids.select("id").distinct(), "id").groupBy("id").agg(F.min(F.struct("rank", "entity_type", "label")).alias("r"))
    return found.select(F.col("id").alias("entity_id"), "r.entity_type", "r.label")


def with_owner(expertise: DataFrame, contributors: DataFrame) -> DataFrame:
    """expertise with the contributor's name and e-mail, empty where the contributor is unknown."""
    who = contributors.select(F.col("id").alias("contributor_id"), "name", "email")
    return expertise.join(who, "contributor_id", "left").fillna("", ["name", "email"])


def memory_counts(decisions: DataFrame, intents: DataFrame, facts: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, n): one union, one aggregate; kinds without rows count 0."""
    kinds = {"decisions": decisions, "intents": intents, "facts": facts, "events": events}
    rows = None
    for kind, table in kinds.items():
        own = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def dominant_language(files: DataFrame) -> DataFrame:
    """(language) of files(path): by a marker file at the root, else by the most common suffix (the smallest on a tie).

    Fixed values: the markers in their order, and the suffixes that count.
    """
    markers = (("go.mod", "go"), ("package.json", "javascript"), ("Cargo.toml", "rust"), ("pyproject.toml", "python"), ("setup.py", "python"))
    suffixes = {".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".rs": "rust"}
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    mark = F.coalesce(*[F.when(F.col("path") == name, F.struct(F.lit(i).alias("place"), F.lit(x).alias("language"))) for i, (name, x) in enumerate(markers)])
    counts = files.select(suffix.alias("suffix"), mark.alias("mark")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("mark"))
    best = F.min(F.when(F.col("suffix") != "", F.struct((-F.col("n")).alias("by"), "suffix")))
    named = F.coalesce(*[F.when(F.col("best.suffix") == s, F.lit(x)) for s, x in suffixes.items()], F.lit(""))
    return counts.agg(F.min("mark").alias("mark"), best.alias("best")).select(F.coalesce("mark.language", named).alias("language"))


def evidence_counts(evidence: DataFrame) -> DataFrame:
    """(source, kind, n) of evidence rows."""
    return evidence.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


def changed_modules(files: list[DataFrame], markers: DataFrame) -> DataFrame:
    """(path, module) of the files that any list (path) names, each once."""
    from .code import module_roots

    rows = files[0].select("path")
    for f in files[1:]:
        rows = rows.union(f.select("path"))
    return module_roots(rows.where("path <> ''").distinct(), markers)
