"""Connected components of a link table, by rounds of star contraction.

Each round sends every vertex's neighbours to its smallest one (a large star, then a small star), which keeps
components and at least halves their depth.  Each round is written to the shared checkpoint folder, so a lost
executor costs one round.  The driver sees only counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b).  (vertex, component) for each vertex of a link; component is the smallest vertex reachable."""
    now = stored(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = stored(_small_star(_large_star(now)), "links")
        found = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first()
        if found == mark and found[0] == found[2]:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        mark = found
