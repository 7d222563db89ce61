"""A version-control repository's commits as a Spark data source, in batch and as a stream.

The stream's offset is a commit: a micro-batch holds what lies between the last commit read and the head, and nothing where the head
has not moved.  Where the last commit is no longer known (rewritten history), all commits up to the head are read again; merging
by id makes that harmless.  Commits are read in slices, each by a task of its own, which counts from the range's end; the driver sees
counts and two hashes.  The repository's folder must be readable from all executors.

Options: path; slice (commits of a task); since and until (batch only: the commit to begin after, and the one to end with, HEAD by default).
Rows: value, the record of a commit by lines (hash, author, date, message), as ``files.parse_commits`` takes it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT, SLICE = "commit_log", 5000
# fixed values: a record's lines
PRETTY = "--pretty=format:%H%n%an <%ae>%n%ad%n%B%x00"
DATES = "--date=iso-strict"


def git(path: str, *arguments: str) -> str:
    done = subprocess.run(["git", "-C", path, *arguments], capture_output=True, text=True, errors="replace", check=False)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]} in {path}: {done.stderr.strip()}")
    return done.stdout


def head(path: str, name: str = "HEAD") -> str:
    """The commit that a name stands for; empty where the repository has none yet."""
    done = subprocess.run(["git", "-C", path, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}"], capture_output=True, text=True, check=False)
    if done.returncode and name != "HEAD":
        raise RuntimeError(f"{name} is no commit of {path}")
    if done.returncode:
        git(path, "rev-parse", "--git-dir")  # no repository at all is an error
    return done.stdout.strip()


def known(path: str, commit: str) -> bool:
    return subprocess.run(["git", "-C", path, "cat-file", "-e", f"{commit}^{{commit}}"], capture_output=True, check=False).returncode == 0


def commit_range(path: str, since: str, until: str) -> list[str]:
    """Arguments that name the commits after since up to until; all up to until where since is empty or unknown; none where they are equal."""
    if not until or since == until:
        return []
    return [until, f"^{since}"] if since and known(path, since) else [until]


class Slice(InputPartition):
    def __init__(self, names: list[str], skip: int, count: int):
        self.names, self.skip, self.count = names, skip, count


def slices(path: str, names: list[str], size: int) -> list[Slice]:
    total = int(git(path, "rev-list", "--count", *names)) if names else 0
    return [Slice(names, at, size) for at in range(0, total, size)]


def read_slice(path: str, part: Slice) -> Iterator[tuple[str]]:
    """The records of a slice, as the log streams by."""
    with subprocess.Popen(["git", "-C", path, "log", f"--skip={part.skip}", f"--max-count={part.count}", PRETTY, DATES, *part.names], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as log:
        rest = b""
        while data := log.stdout.read(1 << 20):
            *whole, rest = (rest + data).split(b"\0")
            for record in whole:
                if text := record.decode(errors="replace").strip():
                    yield (text,)
        problem = log.stderr.read().decode(errors="replace").strip()
    if log.returncode:
        raise RuntimeError(f"git log in {path}: {problem}")


class CommitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("commit_log needs the path of a repository")
        return self.options["path"].removeprefix("file://")

    def _size(self) -> int:
        return int(self.options.get("slice", SLICE))

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(self._path(), self._size(), self.options.get("since", ""), self.options.get("until", "HEAD"))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802 - Spark's name
        return StreamReader(self._path(), self._size())


class BatchReader(DataSourceReader):
    def __init__(self, path: str, size: int, since: str, until: str):
        self.path, self.size, self.since, self.until = path, size, since, until

    def partitions(self) -> list[Slice]:
        return slices(self.path, commit_range(self.path, self.since, head(self.path, self.until)), self.size) or [Slice([], 0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple[str]]:
        if partition.names:
            yield from read_slice(self.path, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commit": head(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return slices(self.path, commit_range(self.path, start["commit"], end["commit"]), self.size)

    def read(self, partition: Slice) -> Iterator[tuple[str]]:
        yield from read_slice(self.path, partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: the offsets in the stream's checkpoint are the cursor."""


def register(spark: SparkSession) -> None:
    from ..session import ship

    ship(spark)
    spark.dataSource.register(CommitLog)


def commits(spark: SparkSession, path: str, repository_id: str, since: str = "", until: str = "HEAD") -> DataFrame:
    """The commits after since as sources."""
    from .files import parse_commits

    register(spark)
    return parse_commits(spark.read.format(FORMAT).option("since", since).option("until", until).load(path), repository_id)


def commit_stream(spark: SparkSession, path: str, repository_id: str, size: int = SLICE) -> DataFrame:
    """The same as a stream that begins with all commits and goes on with new ones."""
    from .files import parse_commits

    register(spark)
    return parse_commits(spark.readStream.format(FORMAT).option("slice", size).load(path), repository_id)
