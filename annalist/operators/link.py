"""Edges between memories: every join is an equi-join, similarity by exploded tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import classes
from .graph import union_all


def _edges(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.select(t.sha_key("relationship_", "from_id", "to_id", F.lit(kind)).alias("id"), "from_id", "to_id", F.lit(kind).alias("relationship_type"))


def _sharing_a_word(left: DataFrame, words_left: Column, right: DataFrame, words_right: Column) -> DataFrame:
    """Distinct (from_id, to_id) with a word in common.  Words of one side alone fall out in the join's shuffle."""
    a = left.select(F.col("id").alias("from_id"), F.explode(words_left).alias("word"))
    b = right.select(F.col("id").alias("to_id"), F.explode(words_right).alias("word"))
    return a.join(b, "word").select("from_id", "to_id").distinct()


def intent_decision(intents: DataFrame, decisions: DataFrame) -> DataFrame:
    pairs = intents.where("source_id <> ''").select(F.col("id").alias("from_id"), "source_id").join(decisions.select(F.col("id").alias("to_id"), "source_id"), "source_id")
    return _edges(pairs, "INTENT_DRIVES_DECISION")


def decision_event(decisions: DataFrame, events: DataFrame) -> DataFrame:
    return _edges(_sharing_a_word(decisions, t.clean_words(F.col("title")), events, t.clean_words(F.col("title"))), "DECISION_RESULTS_IN_EVENT")


def fact_decision(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    words = F.array_distinct(F.concat(t.clean_words(F.col("subject")), t.clean_words(F.col("object"))))
    return _edges(_sharing_a_word(facts, words, decisions, t.clean_words(F.col("title"))), "FACT_SUPPORTS_DECISION")


def word_links(decisions: DataFrame, events: DataFrame, facts: DataFrame) -> dict[str, classes.Links]:
    """The links by words of ``decision_event`` and ``fact_decision``, without their pairs."""
    title = t.clean_words(F.col("title"))
    words = F.array_distinct(F.concat(t.clean_words(F.col("subject")), t.clean_words(F.col("object"))))
    return {"DECISION_RESULTS_IN_EVENT": classes.links(decisions, title, events, title), "FACT_SUPPORTS_DECISION": classes.links(facts, words, decisions, title)}


def link_counts(intents: DataFrame, decisions: DataFrame, events: DataFrame, facts: DataFrame, found: dict[str, classes.Links] | None = None) -> DataFrame:
    """(id, relationship_type, outgoing, n): how many stored edges of each type a memory has, by direction."""
    found = found or word_links(decisions, events, facts)
    driven = intents.where("source_id <> ''").select("source_id", F.col("id").alias("from_id")).join(decisions.select("source_id", F.col("id").alias("to_id")), "source_id")
    kind = "INTENT_DRIVES_DECISION"
    parts = [driven.groupBy(F.col(c).alias("id")).agg(F.count(F.lit(1)).alias("n")).select("id", F.lit(kind).alias("relationship_type"), F.lit(c == "from_id").alias("outgoing"), "n") for c in ("from_id", "to_id")]
    for kind, own in found.items():
        parts += [classes.degrees(own, side).select("id", F.lit(kind).alias("relationship_type"), F.lit(side == 0).alias("outgoing"), F.col("degree").alias("n")) for side in (0, 1)]
    return union_all(parts).where("n > 0")


def event_degrees(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """(id, degree) of the events that decisions result in: their links of ``decision_event``, without pairs and without the links of others."""
    title = t.clean_words(F.col("title"))
    return classes.degrees(classes.links(decisions, title, events, title), 1).where("degree > 0")


def memory_components(intents: DataFrame, decisions: DataFrame, events: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, component) of linked memories."""
    return classes.linked_components(list(word_links(decisions, events, facts).values()), intent_decision(intents, decisions))


def stored_edges(intents: DataFrame, decisions: DataFrame, events: DataFrame, facts: DataFrame) -> DataFrame:
    return intent_decision(intents, decisions).unionByName(decision_event(decisions, events)).unionByName(fact_decision(facts, decisions))


_CHAR = r"\s\[\]()<>\"'`,;"  # what no name holds
#: A run of name characters with one of ./_ in it; possessive, so that a run without one is read once.
_NAME = rf"[^{_CHAR}./_]*+[./_][^{_CHAR}]*+"
#: What a line with a name of ``names`` below has: most lines of prose have none of it, and aren't searched for names.
_SIGN = rf"/|decision_|\.[.:!?*]*[^{_CHAR}.:!?*]"


def decision_dependencies(decisions: DataFrame) -> DataFrame:
    """A decision whose text names another's reference or id depends on it: an explicit wording, else its reference, else its id.

    Explicit are ``[id]``, ``](reference)`` and either after "see", "depends on" or "depends on:".  The names in a text (runs without blanks
    and brackets that hold a dot, a slash or an underscore, and their ends after each slash) are joined by equality, instead of testing all pairs.
    """
    low = F.lower(F.col("content"))
    mark = rf"^(see |depends on:? |\]\(|\[)?({_NAME})([\])])?$"

    def names(found: Column) -> Column:
        wording, closing = F.regexp_extract(found, mark, 1), F.regexp_extract(found, mark, 3)
        name = F.regexp_replace(F.regexp_extract(found, mark, 2), r"[.:!?*]+$", "")
        said = F.when(wording.isin("see ", "depends on ", "depends on: "), "any").when((wording == "](") & (closing == ")"), "reference").when((wording == "[") & (closing == "]"), "id").otherwise("")
        parts = F.split(name, "/")
        ends = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.struct(F.array_join(F.slice(parts, n, F.size(parts)), "/").alias("name"), F.lit("").alias("said")))
        return F.filter(F.concat(F.array(F.struct(name.alias("name"), said.alias("said"))), ends), lambda x: x["name"].rlike(r"[./]|^decision_"))

    # a name begins behind a wording or where its run does: inside a run a search would find what it found at the run's start
    wanted = rf"(?:see |depends on:? |\]\(|\[|(?<![^{_CHAR}])){_NAME}[\])]?"
    lines = F.filter(F.split(low, "\n"), lambda line: line.rlike(_SIGN))  # no name goes beyond its line
    every = F.flatten(F.transform(lines, lambda line: F.filter(F.regexp_extract_all(line, F.lit(wanted), F.lit(0)), lambda x: x.rlike(_SIGN))))
    named = decisions.select(F.col("id").alias("from_id"), F.explode(F.array_distinct(F.flatten(F.transform(every, names)))).alias("n")).select("from_id", "n.*")
    keys = decisions.select(F.col("id").alias("to_id"), F.explode(F.array(F.struct(F.lower("reference").alias("name"), F.lit("reference").alias("kind")), F.struct(F.lower("id").alias("name"), F.lit("id").alias("kind")))).alias("k")).select("to_id", "k.*").where("name <> ''")
    hits = named.join(keys, "name").where("from_id <> to_id")
    explicit = (F.col("said") == "any") | (F.col("said") == F.col("kind"))
    rank = F.when(explicit, 1).when(F.col("kind") == "reference", 2).otherwise(3)
    best = hits.groupBy("from_id", "to_id").agg(F.min(rank).alias("rank"))
    return best.select("from_id", "to_id", F.element_at(F.array(*[F.lit(x) for x in ("explicit_reference", "source_reference", "decision_id")]), F.col("rank")).alias("evidence"))


def fact_support(facts: DataFrame) -> DataFrame:
    """Facts whose object is another fact's subject, whatever the case."""
    a = facts.where("object <> ''").select(F.col("id").alias("from_id"), F.lower("object").alias("name"))
    b = facts.where("subject <> ''").select(F.col("id").alias("to_id"), F.lower("subject").alias("name"))
    return a.join(b, "name").where("from_id <> to_id").select("from_id", "to_id", "name").distinct()


def domain_pairs(expertise: DataFrame) -> DataFrame:
    """Pairs of domains that one contributor has, of (contributor_id, domain): built from each contributor's own list of at most as many domains as there are."""
    own = expertise.groupBy("contributor_id").agg(F.collect_set("domain").alias("d"))
    pairs = own.select("contributor_id", "d", F.explode("d").alias("domain_a")).select("contributor_id", "domain_a", F.explode("d").alias("domain_b"))
    return pairs.where("domain_a < domain_b")
