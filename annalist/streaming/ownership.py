"""Contributors and expertise kept up to date after each batch, with retraction.

What a source adds to its author is kept by author, so a batch recomputes only the people whom its sources belonged to before or belong to
now, and reads only their buckets.  A domain's best score may fall: each bucket keeps its people's best, the buckets that a batch
touches work theirs out anew, and the best of all is the largest of as many rows as there are buckets and domains.  Scores relative to
the best are made when they are read, so a new best rewrites nobody.

Tables: authors (source_id, contributor_id), by source; work (what each source adds), people (contributors), raw (counts and weighted sums by domain)
and best (by bucket and domain, with the last commit's time under the empty domain), by contributor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RECENT_DAYS, WEIGHTS
from ..operators import extract, ownership
from ..storage import cut
from .tables import Change, Snapshot, Tables

PEOPLE = "id string, repository_id string, email string, name string, first_seen timestamp_ntz, last_seen timestamp_ntz, commit_count long"


def work_of(sources: DataFrame) -> DataFrame:
    """(source_id, contributor_id, repository_id, name, email, ts, commit, domains): what each source with an author adds, with counts of each domain."""
    who = ownership.with_contributor(sources).where("contributor_id IS NOT NULL").select(F.col("id").alias("source_id"), "contributor_id", "repository_id", "name", "email", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("source_type") == "commit").alias("commit"))
    records = sources.where("source_type <> 'commit'")
    counts = ownership.domain_counts(sources, extract.events(sources.where("source_type = 'commit'")), extract.decisions(records), extract.facts(records))
    listed = counts.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("domain", *WEIGHTS))).alias("domains"))  # at most as many as there are domains
    return who.join(listed, "source_id", "left").withColumn("domains", F.coalesce("domains", F.array().cast(dict(listed.dtypes)["domains"])))


def people_of(work: DataFrame) -> DataFrame:
    """Contributors from their work: those with commits."""
    return work.where("commit").groupBy(F.col("contributor_id").alias("id"), "repository_id", "email").agg(
        F.min_by("name", F.struct(-F.octet_length("name"), "name")).alias("name"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("commit_count")
    )


def raw_of(work: DataFrame) -> DataFrame:
    """(contributor_id, domain, counts, last, raw) of people with commits."""
    known = work.where("commit").select("contributor_id").distinct()
    rows = work.select("contributor_id", "ts", F.explode("domains").alias("d")).select("contributor_id", "ts", "d.*")
    sums = rows.groupBy("contributor_id", "domain").agg(*[F.sum(k).alias(k) for k in WEIGHTS], F.max("ts").alias("last"))
    return sums.join(known, "contributor_id", "left_semi").withColumn("raw", sum(F.col(k) * w for k, w in WEIGHTS.items()).cast("double"))


def apply(change: Change, sources: DataFrame, gone: DataFrame | None = None) -> list[int]:
    """Takes new or changed sources in and those of gone(id) out; the buckets of people that it rewrote.

    sources: one row per id.  A source that changes its author or text leaves its old author's counts and joins the new one's.
    """
    new = cut(work_of(sources))
    ids = sources.select(F.col("id").alias("source_id"))
    if gone is not None:
        ids = ids.unionByName(gone.select(F.col("id").alias("source_id")))
    ids = cut(ids.distinct())
    if ids.isEmpty():
        return []
    by_source = change.touched(ids, "source_id")
    authors = change.read("authors", by_source)
    owned = new.select("source_id", "contributor_id")
    before = authors.join(ids, "source_id", "left_semi") if authors is not None else owned.where("false")
    people = cut(before.select("contributor_id").unionByName(owned.select("contributor_id")).distinct())
    stay = authors.join(ids, "source_id", "left_anti").select("source_id", "contributor_id").unionByName(owned) if authors is not None else owned
    touched = change.touched(people, "contributor_id")
    work = change.read("work", touched)
    kept = work.join(ids, "source_id", "left_anti").select(*new.columns).unionByName(new) if work is not None else new
    change.replace("authors", stay, by_source, "source_id")
    change.replace("work", kept, touched, "contributor_id")
    mine = change.read("work", touched).join(people, "contributor_id", "left_semi")
    for name, made, key in (("people", people_of(mine), "id"), ("raw", raw_of(mine), "contributor_id")):
        old = change.read(name, touched)
        rest = old.join(people.withColumnRenamed("contributor_id", key), key, "left_anti").select(*made.columns).unionByName(made) if old is not None else made
        change.replace(name, rest, touched, key)
    raw, known = change.read("raw", touched), change.read("people", touched)
    best = raw.select(change.bucket("contributor_id").alias("part"), "domain", "raw").groupBy("part", "domain").agg(F.max("raw").alias("best"), F.lit(None).cast("timestamp_ntz").alias("latest"))
    latest = known.select(change.bucket("id").alias("part"), "last_seen").groupBy("part").agg(F.max("last_seen").alias("latest")).select("part", F.lit("").alias("domain"), F.lit(0.0).alias("best"), "latest")
    made = best.unionByName(latest)
    old = change.read("best")  # a row for each bucket and domain
    every = old.where(~F.col("part").isin(touched)).select(*made.columns).unionByName(made) if old is not None else made
    change.replace("best", cut(every.withColumn("one", F.lit(0))), [b for b in range(change.before.tables.buckets)], "one")
    return touched


def contributors(now: Snapshot | Change) -> DataFrame | None:
    return now.read("people")


def expertise(now: Snapshot | Change) -> DataFrame | None:
    """As ``operators.ownership.expertise`` over all sources: scores relative to the best of each domain, of people with any."""
    raw, parts = now.read("raw"), now.read("best")
    if raw is None:
        return None
    best = parts.where("domain <> ''").groupBy("domain").agg(F.max("best").alias("best"))
    latest = parts.where("domain = ''").agg(F.max("latest").alias("latest"))
    rows = raw.join(F.broadcast(best), "domain").join(F.broadcast(latest), how="cross").where("raw > 0")  # a row for each domain of a fixed list, and one row
    recent = F.coalesce(F.expr(f"latest <= last + INTERVAL {RECENT_DAYS} DAY"), F.lit(False))
    return rows.select("contributor_id", "domain", F.round(F.col("raw") / F.col("best"), 6).alias("score"), *WEIGHTS, recent.alias("recent"))


__all__ = ["Tables", "apply", "contributors", "expertise", "work_of"]
