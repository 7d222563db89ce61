"""Contributors, expertise and what a contributor worked on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DOMAIN_KEYWORDS, RECENT_DAYS, WEIGHTS
from ..functions import text as t
from ..storage import cut
from .extract import event_of, stated
from .graph import union_all


def with_contributor(sources: DataFrame) -> DataFrame:
    """sources with name, email and contributor_id (null where the author is empty)."""
    who = sources.withColumn("_who", t.once(F.coalesce("author", F.lit("")), t.author)).select("*", "_who.name", "_who.email").drop("_who")
    label = F.coalesce(F.nullif(F.col("email"), F.lit("")), F.nullif(F.col("name"), F.lit("")))
    return who.withColumn("contributor_id", F.when(label.isNotNull(), t.sha_key("ctr_", "repository_id", label)))


def _named(rows: DataFrame) -> DataFrame:
    """rows of ``with_contributor`` that have one.  A generator drops the others: a filter on what rows were grouped by would go below the
    grouping, and read each row's author again."""
    return rows.select(*[c for c in rows.columns if c != "contributor_id"], F.explode(F.when(F.col("contributor_id").isNotNull(), F.array("contributor_id"))).alias("contributor_id"))


def contributors(sources: DataFrame) -> DataFrame:
    """One row per author of commits: the longest name (the earliest in byte order on a tie), first and last time, commits."""
    # commits are counted by the author as written, whom alone the rules then read
    written = sources.where("source_type = 'commit'").groupBy("repository_id", "author").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    own = _named(with_contributor(written))
    return own.groupBy(F.col("contributor_id").alias("id"), "repository_id", "email").agg(
        F.min_by("name", F.struct(-F.octet_length("name"), "name")).alias("name"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"), F.sum("n").alias("commit_count")
    )


def domains_of(*texts: Column) -> Column:
    """The domains with a keyword in any of the texts, which are joined and lower-cased once, as a lambda's argument."""

    def found(low: Column) -> Column:
        return F.array_compact(F.array(*[F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in words]), F.lit(name)) for name, words in DOMAIN_KEYWORDS.items()]))

    return F.transform(F.array(F.lower(F.concat_ws("\n", *texts))), found)[0]


def _said(low: str) -> Column:
    """A bit for each domain, in the order of DOMAIN_KEYWORDS, of which a lower-cased text holds a word."""
    return sum((F.when(t.holds(F.col(low), words), 1 << n).otherwise(0) for n, words in enumerate(DOMAIN_KEYWORDS.values())), F.lit(0))


def said_in(sources: DataFrame, events: DataFrame, decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_id, kind, said): a row for each row that speaks of a domain; said has a bit for each domain, in the order of DOMAIN_KEYWORDS.

    Bits come from plain comparisons of the text, lower-cased in a step of its own: compiled code, in which each text is read once.  Rows of no
    domain fall out in a generator; a filter would be pushed down and evaluate the text anew for each word.
    """
    of = lambda rows, kind, *texts: rows.select("source_id", F.lit(kind).alias("kind"), F.lower(F.concat_ws("\n", *texts)).alias("low"))
    commits = sources.where("source_type = 'commit'").select(F.col("id").alias("source_id"), "title")
    rows = [of(commits, "commits", "title"), of(decisions, "decisions", "title"), of(facts, "facts", "subject", "predicate", "object"), of(events, "events", "title", "description")]
    some = F.explode(F.when(F.col("said") > 0, F.array("said"))).alias("said")
    return union_all(r.select("source_id", "kind", _said("low").alias("said")).select("source_id", "kind", some) for r in rows)


def speaking_of(domain: str, rows: DataFrame, *texts: str) -> DataFrame:
    """(source_id, entity_id) of the rows whose texts hold a word of one domain, read as in ``said_in``."""
    low = rows.select("source_id", "id", F.lower(F.concat_ws("\n", *texts)).alias("low"))
    return low.select("source_id", F.explode(F.when(t.holds(F.col("low"), DOMAIN_KEYWORDS[domain]), F.array("id"))).alias("entity_id"))


def summed_by_contributor(scores: DataFrame, sources: DataFrame, name: str) -> DataFrame:
    """(contributor_id, name): scores(source_id, score) summed by who wrote the source; the rules read each author once."""
    who = sources.select(F.col("id").alias("source_id"), "repository_id", "author")
    by_author = scores.join(who, "source_id").groupBy("repository_id", "author").agg(F.sum("score").alias("score"))
    return with_contributor(by_author).groupBy("contributor_id").agg(F.sum("score").alias(name))


def _domains(said: str) -> Column:
    """The domains whose bits are set."""
    return F.array_compact(F.array(*[F.when(F.getbit(said, F.lit(n)) == 1, F.lit(d)) for n, d in enumerate(DOMAIN_KEYWORDS)]))


def domain_counts(sources: DataFrame, events: DataFrame, decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_id, domain, counts of each kind): what each source says in each domain."""
    counts = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long").alias(k) for k in WEIGHTS]
    return said_in(sources, events, decisions, facts).select("source_id", "kind", F.explode(_domains("said")).alias("domain")).groupBy("source_id", "domain").agg(*counts)


def expertise(sources: DataFrame, known: DataFrame, events: DataFrame, decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """Score of each contributor in each domain, relative to the domain's best.

    Rows meet their author as written, in one join, and are counted by author and set of domains; the rules read each author, and sets are
    taken apart, only in what is left.
    """
    who = sources.select(F.col("id").alias("source_id"), "repository_id", "author", "ts")
    counts = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long").alias(k) for k in WEIGHTS]
    by_author = said_in(sources, events, decisions, facts).join(who, "source_id").groupBy("repository_id", "author", "said").agg(*counts, F.max("ts").alias("last"))
    by_person = _named(with_contributor(by_author)).select("contributor_id", F.explode(_domains("said")).alias("domain"), *WEIGHTS, "last").groupBy("contributor_id", "domain").agg(*[F.sum(k).alias(k) for k in WEIGHTS], F.max("last").alias("last"))
    # a row per contributor and domain, read twice here and often afterwards
    raw = cut(by_person.join(known.select(F.col("id").alias("contributor_id")), "contributor_id", "left_semi").withColumn("raw", sum(F.col(k) * w for k, w in WEIGHTS.items())))
    best = raw.groupBy("domain").agg(F.max("raw").alias("best"))
    latest = sources.where("source_type = 'commit'").agg(F.max("ts").alias("latest"))
    # one row for each domain of a fixed list, and one row: both bounded
    return (
        raw.join(F.broadcast(best), "domain")
        .join(F.broadcast(latest), how="cross")
        .where("raw > 0")
        .select("contributor_id", "domain", F.round(F.col("raw") / F.col("best"), 6).alias("score"), *WEIGHTS, F.coalesce(F.expr(f"latest <= last + INTERVAL {RECENT_DAYS} DAY"), F.lit(False)).alias("recent"))
    )


def _spoken(sources: DataFrame, *own: str) -> DataFrame:
    """(own columns, commits, said): what each text of sources says, a row for each text; commits tells whether it is a commit's.

    What a rule makes of an ASCII text by trimming and title-casing holds no word that the text lacks, as no word of a domain has a blank.  So
    events add to their commit's title only where that has other characters, and only lines and statements with a domain's word, other characters
    or marks of emphasis (which facts lose, so that a word may appear) are read for facts.
    """
    other = lambda text: F.octet_length(text) > F.length(text)  # noqa: E731 - holds a character beyond ASCII
    every = tuple(w for words in DOMAIN_KEYWORDS.values() for w in words)
    wanted = lambda text, low: t.holds(low, (*every, "*", "_", "`")) | other(text)
    of = lambda rows, commit, *texts: rows.select(*own, F.lit(commit).alias("commits"), F.lower(F.concat_ws("\n", *texts)).alias("low"))
    titles = sources.where("source_type = 'commit'").select(*own, F.when(F.col("id").isNotNull(), F.col("title")).alias("title"))
    event = F.when(other(F.col("title")), F.transform(event_of(F.col("title")), lambda x: x["title"]))
    records = sources.where("source_type IN ('adr', 'architecture_doc') AND id IS NOT NULL")
    rows = [of(titles, True, "title", event), of(records, False, "title"), of(stated(records, {c: c for c in own}, wanted), False, "subject", "predicate", "object")]
    return union_all(r.select(*own, "commits", _said("low").alias("said")) for r in rows)


def domains(sources: DataFrame) -> DataFrame:
    """(contributor_id, domain): the rows of ``expertise`` without their counts, read from the sources in one pass.

    Which domains a person speaks of is the union of what each text says, so a row per author is exchanged: texts stay with their source's author,
    and neither events nor facts are made whole, counted or joined.  Only where sources share an id do all their authors have the texts of each.
    """
    merged = F.bit_or("said").alias("said"), F.bool_or("commits").alias("commits")
    by_author = _spoken(sources, "repository_id", "author").groupBy("repository_id", "author").agg(*merged)
    shared = cut(sources.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND id IS NOT NULL").select("id"))
    if not shared.isEmpty():
        several = sources.join(shared, "id", "left_semi")
        said = _spoken(several, "id").groupBy("id").agg(F.bit_or("said").alias("said"))
        theirs = several.select("id", "repository_id", "author").join(said, "id").groupBy("repository_id", "author").agg(F.bit_or("said").alias("said"))
        by_author = by_author.unionByName(theirs.withColumn("commits", F.lit(False)))
    by_person = _named(with_contributor(by_author)).groupBy("contributor_id").agg(*merged)
    return by_person.where("commits").select("contributor_id", F.explode(_domains("said")).alias("domain"))


def trace_contributor(sources: DataFrame, contributor_id: Column, events: DataFrame, decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """(kind, id, label) of all that comes from a contributor's sources."""
    own = with_contributor(sources).where(F.col("contributor_id") == contributor_id).select(F.col("id").alias("source_id"))
    rows = (
        events.select(F.lit("event").alias("kind"), "id", F.col("title").alias("label"), "source_id")
        .unionByName(decisions.select(F.lit("decision").alias("kind"), "id", F.col("title").alias("label"), "source_id"))
        .unionByName(facts.select(F.lit("fact").alias("kind"), "id", F.concat_ws(" ", "subject", "predicate", "object").alias("label"), "source_id"))
    )
    return rows.join(own, "source_id", "left_semi").select("kind", "id", "label")
