"""Raw sources from exported commit logs, markdown folders and source trees, read by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RECORD_FOLDERS
from ..functions import text as t


def parse_commits(records: DataFrame, repository_id: str) -> DataFrame:
    """Rows of raw commits (value: hash, author, date and message by lines); the title is the whole message."""
    parts = F.split(F.ltrim("value"), "\n", 4)
    rows = records.where(F.size(parts) >= 3).select(F.trim(parts[0]).alias("id"), F.get(parts, F.lit(1)).alias("author"), t.parse_time(F.trim(F.get(parts, F.lit(2)))).alias("ts"), t.squeeze(F.coalesce(F.get(parts, F.lit(3)), F.lit(""))).alias("title"))
    return rows.select("id", F.lit(repository_id).alias("repository_id"), F.lit("commit").alias("source_type"), F.col("id").alias("reference"), "title", "author", "ts", F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("status"))


def commit_log(spark: SparkSession, path: str, repository_id: str) -> DataFrame:
    """An exported log whose records end in NUL."""
    return parse_commits(spark.read.text(path, lineSep="\0"), repository_id)


def record_header(content: F.Column) -> tuple[F.Column, F.Column]:
    """(title, status) of a decision record: its first # line; a status: line, or the first line after ## Status; else Accepted."""
    title = t.squeeze(F.regexp_extract(content, r"(?m)^# (.*)$", 1))
    inline = t.squeeze(F.regexp_extract(content, r"(?mi)^\s*status:\s*(.*)$", 1))
    section = t.squeeze(F.regexp_extract(content, r"(?mi)^##\s+status\s*\n(?:\s*\n)*(?!\s*#)(.+)$", 1))
    return title, F.coalesce(F.nullif(inline, F.lit("")), F.nullif(section, F.lit("")), F.lit("Accepted"))


def record_folders(configured: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """Configured folders first, then the usual ones, each once per kind."""
    tidy = [(p.strip().strip("/").removeprefix("./"), kind or "adr") for p, kind in (*configured, *RECORD_FOLDERS)]
    return list(dict.fromkeys(x for x in tidy if x[0]))


def markdown_records(spark: SparkSession, root: str, folder: str, kind: str, repository_id: str) -> DataFrame:
    """All *.md below a folder, one row each."""
    files = spark.read.text(f"{root}/{folder}", wholetext=True, pathGlobFilter="*.[mM][dD]", recursiveFileLookup=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), ".*/" + folder.replace(".", "[.]") + "/", folder + "/")
    prefix = "adr_" if kind == "adr" else "archdoc_"
    rows = files.select(path.alias("reference"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("ts"))
    title, status = record_header(F.col("content"))
    return rows.select(t.sha_key(prefix, F.lit(repository_id), "reference").alias("id"), F.lit(repository_id).alias("repository_id"), F.lit(kind).alias("source_type"), "reference", title.alias("title"), F.lit("").alias("author"), "ts", "content", status.alias("status"))


# fixed values: folders that hold no sources
SKIPPED = (".git", "vendor", "bin", "node_modules", "build", "dist", "out", "target", ".next", ".nuxt", ".output", ".cache", "__pycache__", "_build", "coverage", ".agents")


def source_tree(spark: SparkSession, root: str, skipped: tuple[str, ...] = ()) -> DataFrame:
    """(path, text) of the files below root outside skipped folders (and those of a project's own tools, if named); generated Go files fall out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + root.rstrip("/").replace(".", "[.]") + "/", "")
    rows = files.select(path.alias("path"), F.col("value").alias("text"))
    head = F.array_join(F.slice(F.split("text", "\n"), 1, 5), "\n")
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in (*SKIPPED, *skipped)])) & ~(F.col("path").endswith(".go") & head.contains("Code generated")))
