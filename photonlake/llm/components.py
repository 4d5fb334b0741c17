"""Connected components of a link table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """id, root for every id of `links` (long columns a, b): root is the smallest id that can be reached.

    Each round points every larger neighbour at the smallest neighbour, then every smaller one; the rounds needed grow
    with the logarithm of the longest path. Minima are taken before rows are shuffled, and the joins carry two longs a
    row, so a link's end that a third of all rows share is split by the adaptive skew join. Self links and repeats do no
    harm; an empty table gives an empty table. It ends when a round leaves the links as they were; tables of past rounds are
    removed.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).filter("a <> b").distinct()
        nxt = stored(small, "links")
        if nxt.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(nxt, ["a", "b"], "left_anti").isEmpty():
            break
        dropped(edges)
        edges = nxt
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
