"""Source code: languages, symbols, module roots, symbol matching, briefings and links from memories to code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import symbols
from .symbols import imports  # noqa: F401

# fixed values: file suffixes and their languages
SUFFIXES = {
    ".go": "go", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".rs": "rust", ".java": "java", ".cs": "csharp", ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift",
    ".php": "php", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".c": "c", ".h": "c", ".scala": "scala", ".sc": "scala", ".lua": "lua",
    ".sh": "bash", ".bash": "bash", ".sql": "sql", ".dart": "dart", ".ex": "elixir", ".exs": "elixir", ".zig": "zig",
}

def language(path: Column) -> Column:
    """The language by suffix; null where code is not indexed (tests of Go and Python included)."""
    low = F.lower(path)
    base = F.element_at(F.split(low, "/"), -1)
    out = F.lit(None).cast("string")
    for suffix, name in SUFFIXES.items():
        out = F.when(low.endswith(suffix), name).otherwise(out)
    return F.when(low.endswith("_test.go") | (base.startswith("test_") & base.endswith(".py")), None).otherwise(out)


def _parsed(files: DataFrame, parse: Callable, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([row for path, lang, text in zip(frame.path, frame.language, frame.text, strict=True) for row in parse(path, lang, text or "")], columns=names)

    return files.withColumn("language", language(F.col("path"))).where("language IS NOT NULL").select("path", "language", "text").mapInPandas(run, schema)


def first_symbols(path: str, lang: str, text: str) -> list[tuple]:
    """A file's symbols; of equal kinds and qualified names the first."""
    return [*{(x[1], x[3]): x for x in reversed([*symbols.symbols(path, lang, text)])}.values()]


def parse_symbols(files: DataFrame) -> DataFrame:
    """files(path, text) to one row per symbol.  Qualified names begin with the path, in Go with the package: there files of one package may
    share a name, which keeps its first file's row."""
    rows = _parsed(files, first_symbols, symbols.SCHEMA)
    rest = [c for c in rows.columns if c not in ("entity_type", "qualified_name")]
    go = rows.where("language = 'go'").groupBy("entity_type", "qualified_name").agg(F.min(F.struct(*rest)).alias("r")).select("entity_type", "qualified_name", "r.*")
    return rows.where("language <> 'go'").unionByName(go)


def package_symbols(rows: DataFrame) -> DataFrame:
    """The packages of parsed symbols, in their columns: the root's is named main, others by their last folder."""
    base = F.when(F.col("package_path") == ".", "main").otherwise(F.element_at(F.split("package_path", "/"), -1))
    own = rows.groupBy("package_path").agg(F.min("language").alias("language"))
    made = {"path": F.col("package_path"), "entity_type": F.lit("package"), "name": base, "qualified_name": F.col("package_path"), "package_path": F.col("package_path"), "language": F.col("language"), "signature": F.lit("")}
    return own.select(*[made.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in rows.dtypes])


def parse_claims(files: DataFrame) -> DataFrame:
    """files(path, text) to the relations that they name (see ``symbols.claims``)."""
    return _parsed(files, symbols.claims, symbols.CLAIMS)


def resolve_claims(claims: DataFrame, entities: DataFrame, module: str = "") -> DataFrame:
    """(relationship_type, from_id, to_id, line): claims whose ends are entities, joined by name; each relation once, at its first line.

    entities: (id, entity_type, name, qualified_name, package_path).  IMPORTS lead to a package: in Go one below the module's path.
    """
    types = entities.where("entity_type IN ('struct', 'interface', 'type_alias')").select("package_path", F.col("name"), "entity_type", "id")
    least = types.groupBy("package_path", "name").agg(F.min(F.when(F.col("entity_type") == "struct", F.col("id"))).alias("struct_id"), F.min(F.when(F.col("entity_type") == "interface", F.col("id"))).alias("interface_id"), F.min("id").alias("type_id"))
    left = least.select("package_path", F.col("name").alias("from_name"), F.col("struct_id").alias("from_id"))
    typed = claims.where("relationship_type IN ('DEPENDS_ON', 'IMPLEMENTS')").join(left, ["package_path", "from_name"]).join(least.withColumnRenamed("name", "to_name").drop("struct_id"), ["package_path", "to_name"])
    typed = typed.select("relationship_type", "from_id", F.when(F.col("relationship_type") == "IMPLEMENTS", F.col("interface_id")).otherwise(F.col("type_id")).alias("to_id"), "line").where("from_id <> to_id")
    packages = entities.where("entity_type = 'package'").groupBy("package_path").agg(F.min("id").alias("package_id"))
    files = entities.where("entity_type = 'file'").groupBy(F.col("qualified_name").alias("from_name")).agg(F.min("id").alias("from_id"))
    target = F.col("to_name")
    if module:
        target = F.when(F.col("path").endswith(".go"), F.when(target == module, ".").when(target.startswith(module + "/"), F.substring(target, len(module) + 2, 1 << 20))).otherwise(target)
    imported = claims.where("relationship_type = 'IMPORTS'").withColumn("to_package", target).join(files, "from_name").join(packages.select(F.col("package_path").alias("to_package"), F.col("package_id").alias("to_id")), "to_package")
    ends = entities.where("entity_type = 'endpoint'").select("package_path", F.col("name").alias("to_name"), F.col("id").alias("to_id"))
    exposed = claims.where("relationship_type = 'EXPOSES_ENDPOINT'").join(packages.withColumnRenamed("package_id", "from_id"), "package_path").join(ends, ["package_path", "to_name"])
    keep = ("relationship_type", "from_id", "to_id", "line")
    return typed.unionByName(imported.select(*keep)).unionByName(exposed.select(*keep)).where("from_id IS NOT NULL AND to_id IS NOT NULL").groupBy(*keep[:3]).agg(F.min("line").alias("line"))


def module_roots(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, module): the nearest folder above that holds a marker file, else the first part of the path; markers: (folder)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    near = paths.select("path", F.explode(above).alias("folder")).join(markers.select("folder").distinct(), "folder").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("found"))
    return paths.join(near, "path", "left").select("path", F.coalesce("found", parts[0]).alias("module"))


def symbol_matches(entities: DataFrame, symbol: str, package: str = "") -> DataFrame:
    """Entities of the exact qualified name; if there is none, those of the name or ending in it, whatever the case."""
    low = symbol.lower()
    whole, name = F.lower("qualified_name"), F.lower("name")
    rows = entities.withColumn("_exact", F.col("qualified_name") == symbol).where(F.col("_exact") | (name == low) | (whole == low) | whole.endswith("." + low))
    if package:
        rows = rows.where((F.col("package_path") == package) | F.col("package_path").endswith("/" + package))
    any_exact = rows.agg(F.coalesce(F.max("_exact"), F.lit(False)).alias("_any"))  # one row
    return rows.join(F.broadcast(any_exact), how="cross").where("_exact OR NOT _any").select(*entities.columns)


def symbol_dependencies(relations: DataFrame) -> DataFrame:
    return relations.where(F.col("relationship_type").isin("CALLS", "REFERENCES", "DEPENDS_ON", "IMPORTS"))


def briefing(entities: DataFrame, relations: DataFrame, most: int = 6) -> DataFrame:
    """For each entity its first related ones by type and name, and how many are left out."""
    own = symbol_dependencies(relations).select(F.col("from_id").alias("id"), F.col("to_id"), "relationship_type").distinct()
    named = own.join(entities.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("label")), "to_id")
    order = Window.partitionBy("id").orderBy("relationship_type", "label", "to_id")
    return named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]), ",").alias("related"), F.count(F.lit(1)).alias("shown"))


def bridge(memories: DataFrame, entities: DataFrame) -> DataFrame:
    """(memory_id, code_id, strategy): files, packages, qualified and unique short names that a memory's text holds; the first strategy counts.

    memories: (memory_id, kind, text); events never match symbols.  Names are cut out of the text and joined by equality.
    """
    files = memories.select("memory_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|[\s\"'(,])([a-zA-Z0-9][\w./-]*\.[a-z]{1,5})\b"), F.lit(1)))).alias("name"))
    packages = memories.select("memory_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?:^|[\s\"'(,])((?:internal|cmd|pkg)/[\w./-]+)"), F.lit(1)))).alias("name"))
    spoken = memories.where("kind <> 'EVENT'")
    qualified = spoken.select("memory_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_.]+"), F.lit(0)))).alias("name"))
    short = spoken.select("memory_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z][a-zA-Z0-9]{2,})\b"), F.lit(1)))).alias("name"))
    unique = entities.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("code_id")).where("n = 1").drop("n")
    found = [
        files.join(entities.where("entity_type = 'file'").select(F.col("file_path").alias("name"), F.col("id").alias("code_id")), "name").withColumn("rank", F.lit(1)),
        packages.join(entities.where("entity_type = 'package'").select(F.col("package_path").alias("name"), F.col("id").alias("code_id")), "name").withColumn("rank", F.lit(2)),
        qualified.join(entities.select(F.lower("qualified_name").alias("name"), F.col("id").alias("code_id")), "name").withColumn("rank", F.lit(3)),
        short.join(unique, "name").withColumn("rank", F.lit(4)),
    ]
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    names = F.element_at(F.array(*[F.lit(x) for x in ("file_path", "package_path", "qualified_name", "short_name")]), F.col("rank"))
    return rows.groupBy("memory_id", "code_id").agg(F.min("rank").alias("rank")).select("memory_id", "code_id", names.alias("strategy"))


def resolve_calls(calls: DataFrame, entities: DataFrame) -> DataFrame:
    """(caller_id, callee_id) of calls(caller_id, package_path, qualifier, name): a function of the package, of an imported one, a method of the
    receiver's type, else the only method of that name in the package."""
    fn = entities.where("entity_type = 'function'").select("package_path", "name", F.col("id").alias("callee"))
    method = entities.where("entity_type = 'method'").select("package_path", "receiver", "name", F.col("id").alias("callee"))
    only = method.groupBy("package_path", "name").agg(F.count(F.lit(1)).alias("n"), F.min("callee").alias("d")).where("n = 1").drop("n")
    first = lambda rows, *keys: rows.groupBy(*keys).agg(F.min("callee").alias("callee"))
    own = first(fn, "package_path", "name").withColumnRenamed("callee", "a")
    imported = first(fn, "package_path", "name").select(F.col("package_path").alias("qualifier"), "name", F.col("callee").alias("b"))
    typed = first(method, "package_path", "receiver", "name").select("package_path", F.col("receiver").alias("qualifier"), "name", F.col("callee").alias("c"))
    rows = calls.join(own, ["package_path", "name"], "left").join(imported, ["qualifier", "name"], "left").join(typed, ["package_path", "qualifier", "name"], "left").join(only, ["package_path", "name"], "left")
    callee = F.when(F.col("qualifier").isNull(), F.col("a")).otherwise(F.coalesce("b", "c", "d"))
    return rows.select("caller_id", callee.alias("callee_id")).where("callee_id IS NOT NULL").distinct()


def counters(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts of the code index."""
    kinds = {"files": "file", "packages": "package", "functions": "function", "structs": "struct"}
    counts = [F.countDistinct(F.when(F.col("entity_type") == k, F.col("id"))).alias(n) for n, k in kinds.items()]
    return entities.agg(*counts).join(relations.agg(F.count(F.lit(1)).alias("relations")), how="cross")


# fixed values: the role of a package by its first folder
LAYERS = {"cmd": "CLI entry and command wiring", "pkg": "public API surface", "internal": "core implementation", "api": "HTTP/API layer", "web": "web/UI layer"}


def package_layer(path: Column) -> Column:
    """The role of a package: by its first folder, with the second's name if it has one; else its last folder."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    layer = F.lit(None).cast("string")
    for part, role in LAYERS.items():
        layer = F.when(parts[0] == part, role).otherwise(layer)
    many = F.size(parts) > 1
    named = F.when(many, F.concat(F.get(parts, F.lit(1)), F.lit(" ("), layer, F.lit(")"))).otherwise(layer)
    return F.when(parts[0] == "", "").when(layer.isNotNull(), named).when(many, F.concat(F.element_at(parts, -1), F.lit(" package"))).otherwise("")


def entity_role(kind: Column, name: Column, package: Column) -> Column:
    hint = package_layer(package)
    return F.when(hint != "", F.concat(kind, F.lit(" "), name, F.lit(" — "), hint)).otherwise(F.concat(kind, F.lit(" "), name, F.lit(" in package "), package))


def topic_of_files(files: DataFrame) -> DataFrame:
    """(topic, n) of the most common topic; the smallest on a tie.  A file's topic is its folder below internal, pkg or cmd, else its name without suffix."""
    parts = F.split("path", "/")
    key = F.when((F.size(parts) >= 2) & parts[0].isin("internal", "pkg", "cmd"), F.get(parts, F.lit(1))).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))
    return files.select(key.alias("topic")).where("topic <> ''").groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(1)
