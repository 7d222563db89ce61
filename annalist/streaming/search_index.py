"""A search index that takes inserts, updates and deletes, in segments that are never changed.

A batch of documents becomes a new segment of postings.  What it replaces or deletes is marked in small lists beside the older segments (deletion
vectors), which alone are written anew.  When FANOUT segments of one tier (sizes by powers of FANOUT) have come together they are merged
into one without their deleted documents, so a document is rewritten as often as there are tiers and a small batch touches no large segment.
Live numbers of documents and words are kept by segment and repository, so a search reads no document list.

Tables of a change (see ``tables``): postings, documents, deleted and totals, each with a place for every segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..storage import cut
from .tables import Change, Snapshot

FANOUT = 4
#: The name under which a log entry keeps a segment's size.
SIZE = "segment "
KEYS = "segment int, repository_id string, id string"


def sizes(now: Snapshot | Change) -> dict[int, int]:
    """Documents of each segment when it was written."""
    return {int(n.removeprefix(SIZE)): size for n, size in now.streams.items() if n.startswith(SIZE)}


def _tier(size: int) -> int:
    tier = 0
    while size >= FANOUT:
        size, tier = size // FANOUT, tier + 1
    return tier


def _write(change: Change, number: int, counted: DataFrame) -> None:
    """A segment of documents with their words counted: stored once under new numbers, and its postings from there."""
    change.put("documents", number, counted.select(F.lit(number).alias("segment"), F.monotonically_increasing_id().alias("doc"), *[c for c in counted.columns if c not in ("segment", "doc")]))
    own = change.read("documents", [number])
    change.put("postings", number, search.postings(own, "segment", "doc"))
    change.put("deleted", number, own.sparkSession.createDataFrame([], KEYS))
    change.put("totals", number, own.groupBy("segment", "repository_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("words")))
    change.streams[f"{SIZE}{number}"] = own.count()


def _drop(change: Change, numbers: list[int]) -> None:
    for n in numbers:
        change.streams.pop(f"{SIZE}{n}")
        for name in ("postings", "documents", "deleted", "totals"):
            change.places.pop((name, n))


def _live(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    return rows.join(deleted.select("segment", "repository_id", "id"), ["segment", "repository_id", "id"], "left_anti")


def apply(change: Change, documents: DataFrame, gone: DataFrame | None = None) -> None:
    """Puts documents(repository_id, id, entity_type, title, content) in, in place of older ones of their keys, and takes those of gone(repository_id, id) out.

    Of several rows of one key in a batch the greatest counts.
    """
    documents = documents.select("repository_id", "id", "entity_type", "title", "content").groupBy("repository_id", "id").agg(F.max(F.struct("entity_type", "title", "content")).alias("d")).select("repository_id", "id", "d.*")
    key = ["repository_id", "id"]
    old = change.read("documents")
    if old is not None:
        keys = documents.select(*key) if gone is None else documents.select(*key).unionByName(gone.select(*key))
        hit = cut(_live(old, change.read("deleted")).join(keys.distinct(), key, "left_semi").select("segment", *key, "length"))
        for number in sorted(r.segment for r in hit.select("segment").distinct().collect()):  # a row for each segment
            mine = hit.where(F.col("segment") == number)
            change.put("deleted", number, cut(change.read("deleted", [number]).unionByName(mine.select("segment", *key))))
            lost = mine.groupBy("segment", "repository_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_w"))
            left = change.read("totals", [number]).join(lost, ["segment", "repository_id"], "left")
            change.put("totals", number, cut(left.select("segment", "repository_id", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"), (F.col("words") - F.coalesce("_w", F.lit(0))).alias("words"))))
    if not documents.isEmpty():
        number = max([*sizes(change), 0]) + 1
        _write(change, number, search.counted_words(documents))
    merge(change)


def merge(change: Change) -> None:
    """Merges each tier that is full, the smallest first; what comes out may fill the next."""
    while True:
        tiers: dict[int, list[int]] = {}
        for number, size in sizes(change).items():
            tiers.setdefault(_tier(size), []).append(number)
        full = min((t for t, found in tiers.items() if len(found) >= FANOUT), default=None)
        if full is None:
            return
        parts = sorted(tiers[full])
        number = max(sizes(change)) + 1
        _write(change, number, _live(change.read("documents", parts), change.read("deleted", parts)))
        _drop(change, parts)


def rebuild(change: Change, repository_id: str, documents: DataFrame) -> None:
    """A repository's documents in place of all that the index has of it; other repositories stay."""
    old = change.read("documents")
    gone = old.where(F.col("repository_id") == repository_id).select("repository_id", "id").join(documents.select("repository_id", "id"), ["repository_id", "id"], "left_anti") if old is not None else None
    apply(change, documents.where(F.col("repository_id") == repository_id), gone)


def index(now: Snapshot | Change, repository_id: str | None = None) -> search.Index | None:
    """The live postings and numbers, of all repositories or one, as ``search.bm25`` takes them; None before the first change."""
    postings = now.read("postings")
    if postings is None:
        return None
    documents = _live(now.read("documents"), now.read("deleted"))
    mine = lambda rows: rows if repository_id is None else rows.where(F.col("repository_id") == repository_id)
    totals = mine(now.read("totals")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    return search.Index(search.listed(postings, mine(documents), "segment", "doc"), totals.select("n", (F.col("words") / F.col("n")).alias("mean")))
