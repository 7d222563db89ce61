"""Links by shared words without their pairs.

Titles that share a word are linked across two sides.  Instead of all pairs this keeps members by word:

* cold words, which few members of either side have, give their few pairs;
* hot words give classes: the members of a side with the same set of hot words count as one row.

Degrees are exact all the same: a member's links are those that its class has by hot words, and its cold pairs without a hot word in common.
How many members of the other side share any of a class's words comes from counts by subsets of words (inclusion and exclusion); sets of more
than MOST hot words meet class by class instead.  Components and reach go over words as nodes.  Pairs are made only for ids asked for.
All tables are linear in the members' words, also where every title has one word in common.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graph import components, union_all

#: Members of a side beyond which a word is hot; hot words whose subsets are counted.
HOT, MOST = 64, 8


@dataclass(frozen=True)
class Links:
    """words: (side, id, word, hot) of words that both sides have; members: (side, id, hot array); classes: (side, hot, n); cold: (from_id, to_id)
    that share a cold word and no hot one."""

    words: DataFrame
    members: DataFrame
    classes: DataFrame
    cold: DataFrame


def links(left: DataFrame, words_left: Column, right: DataFrame, words_right: Column, hot: int = HOT) -> Links:
    """The links between two tables with an id each; words are array columns."""
    side = lambda rows, words, n: rows.select(F.lit(n).alias("side"), F.col("id").cast("string").alias("id"), words.alias("w"))
    # a row for each member, not for each of its words, is exchanged and stored
    lists = cut(side(left, words_left, 0).unionByName(side(right, words_right, 1)).where(F.size("w") > 0).groupBy("side", "id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w")))
    both = lists.select("side", "id", F.explode("w").alias("word"))
    counted = both.groupBy("word").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("l"), F.sum("side").alias("r")).where("l > 0 AND r > 0")
    words = cut(both.join(counted.select("word", ((F.col("l") > hot) | (F.col("r") > hot)).alias("hot")), "word").select("side", "id", "word", "hot"))
    members = cut(words.groupBy("side", "id").agg(F.array_sort(F.collect_set(F.when(F.col("hot"), F.col("word")))).alias("hot")))
    classes = cut(members.where(F.size("hot") > 0).groupBy("side", "hot").agg(F.count(F.lit(1)).alias("n")))
    few = words.where("NOT hot")
    pairs = few.where("side = 0").select(F.col("id").alias("from_id"), "word").join(few.where("side = 1").select(F.col("id").alias("to_id"), "word"), "word").select("from_id", "to_id").distinct()
    of = lambda n, key, name: members.where(F.col("side") == n).select(F.col("id").alias(key), F.col("hot").alias(name))
    cold = pairs.join(of(0, "from_id", "_l"), "from_id").join(of(1, "to_id", "_r"), "to_id").where(~F.arrays_overlap("_l", "_r")).select("from_id", "to_id")
    return Links(words, members, classes, cut(cold))


def _subsets(words: Column) -> Column:
    """(key, sign) of the non-empty subsets of a small array: the sign with which counts of the subset add up to a union's."""
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size(words)).cast("int") - 1)
    chosen = lambda m: F.filter(words, lambda _, i: F.getbit(m.cast("long"), i) == 1)
    return F.transform(masks, lambda m: F.struct(F.array_join(chosen(m), "\0").alias("key"), F.when(F.size(chosen(m)) % 2 == 1, 1).otherwise(-1).alias("sign")))


def _met(classes: DataFrame, side: int, most: int) -> DataFrame:
    """(hot, met): how many members of the other side share a hot word with each class of a side."""
    own, other = classes.where(F.col("side") == side), classes.where(F.col("side") == 1 - side)
    small = lambda rows: rows.where(F.size("hot") <= most)
    large = lambda rows: rows.where(F.size("hot") > most)
    spread = lambda rows: rows.select("hot", "n", F.explode(_subsets(F.col("hot"))).alias("s")).select("hot", "n", "s.*")
    counts = spread(small(other)).groupBy("key").agg(F.sum("n").alias("count"))
    by_subset = spread(small(own)).select("hot", "key", "sign").join(counts, "key").groupBy("hot").agg(F.sum(F.col("sign") * F.col("count")).alias("met"))
    by_word = lambda a, b: (
        a.select("hot", F.explode("hot").alias("word")).join(b.select(F.col("hot").alias("_hot"), "n", F.explode("hot").alias("word")), "word").select("hot", "_hot", "n").distinct().groupBy("hot").agg(F.sum("n").alias("met"))
    )
    return union_all([by_subset, by_word(large(own), other), by_word(small(own), large(other))]).groupBy("hot").agg(F.sum("met").alias("met"))


def degrees(found: Links, side: int, most: int = MOST) -> DataFrame:
    """(id, degree) of the members of a side that are linked: as many as the distinct members of the other side that share a word."""
    members = found.members.where(F.col("side") == side)
    cold = found.cold.groupBy(F.col("to_id" if side else "from_id").alias("id")).agg(F.count(F.lit(1)).alias("c"))
    rows = members.join(_met(found.classes, side, most), "hot", "left").join(cold, "id", "left")
    return rows.select("id", (F.coalesce("met", F.lit(0)) + F.coalesce("c", F.lit(0))).alias("degree"))


def pairs_of(found: Links, ids: DataFrame, side: int) -> DataFrame:
    """(from_id, to_id): the links of the members asked for, ids(id) of a side."""
    asked = found.words.where(F.col("side") == side).join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("_a"), "word")
    pairs = asked.join(found.words.where(F.col("side") == 1 - side).select(F.col("id").alias("_b"), "word"), "word").select("_a", "_b").distinct()
    return pairs.select(F.col("_b" if side else "_a").alias("from_id"), F.col("_a" if side else "_b").alias("to_id"))


def step(found: Links, ids: DataFrame, side: int) -> DataFrame:
    """(id): the members of the other side that the ids of a side lead to, each once, by way of their distinct words."""
    own = found.words.where(F.col("side") == side).join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi").select("word").distinct()
    return found.words.where(F.col("side") == 1 - side).join(own, "word", "left_semi").select("id").distinct()


def linked_components(parts: list[Links], edges: DataFrame) -> DataFrame:
    """(id, component) over links by words and other edges(from_id, to_id): words are nodes of their own, named apart and left out of the result.

    Ids must not begin with a blank, as the words' names do; a component is named by its smallest id.
    """
    hubs = [p.words.select(F.col("id").alias("from_id"), F.concat(F.lit(f" {n}:"), "word").alias("to_id")) for n, p in enumerate(parts)]
    found = cut(components(union_all([edges.select("from_id", "to_id"), *hubs])))
    rows = found.where("id NOT LIKE ' %'")
    least = rows.groupBy("component").agg(F.min("id").alias("least"))
    return rows.join(least, "component").select("id", F.col("least").alias("component"))
