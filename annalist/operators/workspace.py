"""A repository's workspace: discovery, freshness, schema versions, policy, remembered facts and their hand-over, health checks.

The driver handles single small files and rows here; tables stay DataFrames.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Callable
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rank import access_ranking
from .readers import dominant_language

# discovery ----------------------------------------------------------------------------------------------------------


def _git(folder: str, *args: str) -> str:
    done = subprocess.run(["git", *args], cwd=folder, capture_output=True, text=True, check=False)
    return done.stdout.strip() if done.returncode == 0 else ""


def discover(spark: SparkSession, path: str) -> DataFrame:
    """One row (id, name, path, default_branch) of a checkout; a folder without .git is an error.

    The name is that of the remote, else of the folder; the branch is the remote's head, else the own, else main.
    """
    folder = os.path.abspath(path)
    if not os.path.isdir(os.path.join(folder, ".git")):
        raise ValueError(f"not a git repository: {folder}")
    name = _git(folder, "config", "--get", "remote.origin.url").rpartition("/")[2].removesuffix(".git")
    name = name.partition(":")[2] if ":" in name else name
    head = _git(folder, "symbolic-ref", "refs/remotes/origin/HEAD")
    branch = head.removeprefix("refs/remotes/origin/") if head.startswith("refs/remotes/origin/") else ""
    if not branch:
        near = _git(folder, "rev-parse", "--abbrev-ref", "origin/HEAD")
        branch = near.removeprefix("origin/") if near != "origin/HEAD" else ""
    if not branch:
        own = _git(folder, "rev-parse", "--abbrev-ref", "HEAD")
        branch = own if own != "HEAD" else ""
    branch = branch or _git(folder, "symbolic-ref", "--short", "HEAD") or "main"
    key = f"repo_{hashlib.sha256(folder.encode()).digest()[:6].hex()}"
    return spark.createDataFrame([(key, name or os.path.basename(folder), folder, branch)], "id string, name string, path string, default_branch string")


# freshness ----------------------------------------------------------------------------------------------------------

# fixed values: files at the root whose change means that the code index is old
MARKERS = ("go.mod", "go.work", "package.json", "pyproject.toml", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile", "composer.json", "Package.swift", "CMakeLists.txt", "build.sbt", "pubspec.yaml", "mix.exs", "build.zig.zon")


def index_is_current(files: DataFrame, indexed_at: datetime | None, file_count: int) -> bool:
    """Whether files(path, modified) show nothing newer than the last index and as many source files as it had; one aggregate."""
    from .code import language

    if indexed_at is None:
        return False
    source = language(F.col("path")).isNotNull()
    found = files.agg(F.max(F.when(source | F.col("path").isin(*MARKERS), F.col("modified"))).alias("last"), F.sum(source.cast("int")).alias("n")).first()
    return (found.last is None or found.last <= indexed_at) and (found.n or 0) == file_count


# schema versions ----------------------------------------------------------------------------------------------------

_REPO = "id string, repository_id string"
#: (version, name, {table: schema}); the tables of a version come and go together.
MIGRATIONS = (
    (1, "knowledge", {"sources": f"{_REPO}, source_type string, reference string, title string, author string, ts timestamp, content string, status string", "events": f"{_REPO}, source_id string, event_type string, title string, description string", "decisions": f"{_REPO}, source_id string, title string, status string, reference string, content string", "intents": f"{_REPO}, source_id string, description string", "facts": f"{_REPO}, source_id string, subject string, predicate string, object string, created_at timestamp"}),
    (2, "ownership", {"contributors": f"{_REPO}, name string, email string, first_seen timestamp, last_seen timestamp, commit_count long", "expertise": f"{_REPO}, contributor_id string, domain string, score double"}),
    (3, "code", {"code_entities": f"{_REPO}, entity_type string, name string, qualified_name string, file_path string, package_path string, module_path string, language string, start_line int, end_line int, signature string", "code_relations": f"{_REPO}, from_id string, to_id string, relationship_type string", "bridge": f"{_REPO}, memory_id string, code_id string, relationship_type string"}),
)


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


class Migrations:
    """Empty tables of a workspace by version.  Applied versions are folders below ``_versions``, so two writers can't lose one."""

    def __init__(self, spark: SparkSession, folder: str, known: tuple = MIGRATIONS):
        self.spark, self.folder, self.known = spark, folder.rstrip("/"), sorted(known)

    def applied(self) -> list[int]:
        place, files = _place(self.spark, f"{self.folder}/_versions")
        return sorted(int(s.getPath().getName()) for s in files.listStatus(place)) if files.exists(place) else []

    def up(self) -> list[int]:
        """Makes the tables of all versions that are not applied, in order; the versions that it applied.  A table that exists stays."""
        done = set(self.applied())
        pending = [m for m in self.known if m[0] not in done]
        for version, _, tables in pending:
            for name, schema in tables.items():
                self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}")
            place, files = _place(self.spark, f"{self.folder}/_versions/{version}")
            files.mkdirs(place)
        return [m[0] for m in pending]

    def rollback(self) -> int:
        """Drops the tables of the last applied version; none applied, or one that is not known, is an error."""
        done = self.applied()
        if not done:
            raise ValueError("no version to take back")
        version = done[-1]
        tables = {m[0]: m[2] for m in self.known}.get(version)
        if tables is None:
            raise ValueError(f"version {version} is not known")
        for path in (*tables, f"_versions/{version}"):
            place, files = _place(self.spark, f"{self.folder}/{path}")
            files.delete(place, True)
        return version


# policy -------------------------------------------------------------------------------------------------------------

# fixed values: files and folders that a policy is derived from, and the sentences of its hints
CI_FILES = (".gitlab-ci.yml", "Jenkinsfile", "azure-pipelines.yml", "bitbucket-pipelines.yml")
LAYERS = {"cmd/": "CLI entry and command wiring", "internal/": "core implementation", "pkg/": "public API surface", "api/": "HTTP/API layer"}


def derive_policy(files: DataFrame, repository_id: str, record_folders: tuple[str, ...], now: datetime) -> dict:
    """A repository's rules from its files(path): where records lie, its workflows, language and layers, and hints for a release."""
    low = F.lower("path")
    workflow = (F.col("path").startswith(".github/workflows/") & (F.size(F.split("path", "/")) == 3) & (low.endswith(".yml") | low.endswith(".yaml"))) | F.col("path").isin(*CI_FILES)
    holds = lambda prefix, name: F.max(F.col("path").startswith(prefix)).alias(name)
    found = files.agg(F.array_sort(F.collect_set(F.when(workflow, F.col("path")))).alias("ci"), *[holds(p, p) for p in LAYERS], *[holds(f"{p}/", f"record {p}") for p in dict.fromkeys(record_folders)]).first().asDict()
    language = dominant_language(files).first().language
    layers = [{"prefix": p, "role": role} for p, role in LAYERS.items() if found[p]]
    folder = next((p for p in record_folders if found[f"record {p}"]), "")
    hints = [f"Offer a new ADR in {folder} for significant architecture changes"] if folder else []
    if found["ci"]:
        hints.append("Verify CI workflows pass before ship: " + ", ".join(found["ci"]))
    if language == "go" and layers:
        hints.append("Respect repository layer prefixes when adding or moving packages")
    return {"repository_id": repository_id, "generated_at": now.isoformat(), "adr_directory": folder, "require_adr_on_architecture": bool(folder), "ci_workflow_files": found["ci"], "dominant_language": language, "layer_conventions": layers, "ship_check_hints": sorted(hints)}


def write_policy(folder: str, policy: dict) -> Path:
    """The policy as JSON in a workspace, put in place by a rename."""
    path = Path(folder) / "policy.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(f".{os.getpid()}.tmp")
    new.write_text(json.dumps(policy, indent=2) + "\n")
    try:
        new.replace(path)
    except OSError:
        new.unlink(missing_ok=True)
        raise
    return path


def read_policy(folder: str) -> dict | None:
    """The policy of a workspace; None where there is none."""
    path = Path(folder) / "policy.json"
    return json.loads(path.read_text()) if path.exists() else None


# remembered facts ---------------------------------------------------------------------------------------------------

# fixed values: predicates of remembered facts, version of a bundle
REMEMBERED, ASKED, BUNDLE = "SESSION_REMEMBERED", "SESSION_QA", "v1"
FACT = "id string, repository_id string, source_id string, subject string, predicate string, object string, created_at timestamp"


def session_source(repository_id: str) -> str:
    return f"src_session_{hashlib.sha256(f'session:{repository_id}'.encode()).digest()[:8].hex()}"


def remembered(spark: SparkSession, repository_id: str, subject: str, content: str, now: datetime) -> DataFrame:
    """The fact (one row, for ``storage.upsert``) that keeps what a session learned; empty parts are an error."""
    subject, content = subject.strip(), content.strip()
    if not (repository_id and subject and content):
        raise ValueError("a repository, a subject and a content are needed")
    source = session_source(repository_id)
    key = hashlib.sha256(f"{source}{subject}{REMEMBERED}{content}".encode()).hexdigest()
    return spark.createDataFrame([(f"fact_{key}", repository_id, source, subject, REMEMBERED, content, now)], FACT)


def answered(spark: SparkSession, repository_id: str, question: str, answer: str, now: datetime) -> DataFrame:
    """The fact that keeps a question's answer."""
    if not (question.strip() and answer.strip()):
        raise ValueError("a question and an answer are needed")
    return remembered(spark, repository_id, question, f"{question.strip()} => {answer.strip()}", now)


def remembered_rows(rows: DataFrame, repository_id: str) -> DataFrame:
    """rows(subject, content) as facts, equal ones once; rows with an empty part fall out."""
    source = F.lit(session_source(repository_id))
    parts = rows.select(F.trim("subject").alias("subject"), F.trim("content").alias("object")).where("subject <> '' AND object <> ''").distinct()
    key = F.concat(F.lit("fact_"), F.sha2(F.concat(source, "subject", F.lit(REMEMBERED), "object"), 256))
    return parts.select(key.alias("id"), F.lit(repository_id).alias("repository_id"), source.alias("source_id"), "subject", F.lit(REMEMBERED).alias("predicate"), "object")


def session_facts(facts: DataFrame, repository_id: str) -> DataFrame:
    return facts.where((F.col("repository_id") == repository_id) & ((F.col("source_id") == session_source(repository_id)) | F.col("predicate").isin(REMEMBERED, ASKED)))


def forget(facts: DataFrame, repository_id: str, fact_id: str) -> DataFrame:
    """facts without one remembered fact; an id that is no remembered fact of the repository is an error."""
    if session_facts(facts.where(F.col("id") == fact_id), repository_id).isEmpty():
        raise ValueError(f"{fact_id!r} is no remembered fact of {repository_id!r}")
    return facts.where(F.col("id") != fact_id)


def listed(facts: DataFrame, repository_id: str, used: DataFrame) -> DataFrame:
    """Remembered facts with their position, the last used first; used: (id, last_accessed, access_count), facts without a row come last."""
    own = session_facts(facts, repository_id)
    return access_ranking(own.join(used.select("id", "last_accessed", "access_count"), "id", "left").fillna(0, ["access_count"])).drop("last_accessed", "access_count")


def handoff(facts: DataFrame, repository_id: str, used: DataFrame, now: datetime) -> DataFrame:
    """One row (bundle): a repository's remembered facts, which agents write one at a time, as JSON with their ranking."""
    rows = listed(facts, repository_id, used).select("position", *[c.split()[0] for c in FACT.split(", ")])
    key = f"hof_{hashlib.sha256(f'handoff:{repository_id}'.encode()).digest()[:8].hex()}"
    named = rows.agg(F.array_sort(F.collect_list(F.struct("*"))).alias("facts"))
    return named.select(F.to_json(F.struct(F.lit(BUNDLE).alias("version"), F.lit(repository_id).alias("repository_id"), F.lit(key).alias("session_id"), F.lit(now.isoformat()).alias("exported_at"), "facts", F.transform("facts", lambda x: x["id"]).alias("access_ranking"))).alias("bundle"))


def taken_over(spark: SparkSession, bundle: str) -> DataFrame:
    """The facts of a bundle, as the session's own, for ``storage.upsert``; another version or no repository is an error."""
    read = json.loads(bundle)
    if not read.get("repository_id"):
        raise ValueError("a bundle without a repository")
    if read.get("version") != BUNDLE:
        raise ValueError(f"version {read.get('version')!r} of a bundle is not known")
    names = [c.split()[0] for c in FACT.split(", ")]
    source = session_source(read["repository_id"])
    rows = [{**f, "repository_id": read["repository_id"], "source_id": source, "created_at": datetime.fromisoformat(f["created_at"].replace("Z", "+00:00")) if f.get("created_at") else None} for f in read.get("facts", ()) if f]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FACT)


# health -------------------------------------------------------------------------------------------------------------

CHECK = "position int, name string, status string, message string"


def doctor(spark: SparkSession, tables: Callable[[], bool], head: str | None, scanned: str | None, index_current: bool | None, policy: dict | None) -> DataFrame:
    """(position, name, status, message): what is ok, to be looked at (warn) or broken (fail); after a fail nothing more is checked.

    tables: whether the workspace's tables can be read; head: the checkout's last commit, None where it can't be read; scanned: the last
    commit that was ingested; index_current: of ``index_is_current``, None without an index.
    """
    out = []
    put = lambda name, status, message: out.append((len(out) + 1, name, status, message))
    if tables():
        put("workspace", "ok", "tables are readable")
        put("scan_state", "ok" if scanned else "warn", "a scan is recorded" if scanned else "nothing was ingested yet")
        if head is None:
            put("git_head", "warn", "the last commit can't be read")
        elif scanned != head:
            put("git_freshness", "warn", "the repository moved since the last ingestion" if scanned else "never ingested: tables may be empty")
        else:
            put("git_freshness", "ok", "tables match the last commit")
        put("code_index", "ok" if index_current else "warn", "the code index is current" if index_current else "source files changed since the last index" if index_current is False else "there is no code index")
        put("policy", "ok" if policy else "warn", "a policy is present" if policy else "there is no policy")
    else:
        put("workspace", "fail", "tables are missing")
    return spark.createDataFrame(out, CHECK)


def healthy(checks: DataFrame) -> bool:
    return checks.where("status <> 'ok'").isEmpty()
