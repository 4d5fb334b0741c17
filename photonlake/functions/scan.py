"""Running values inside one long stream, in parallel.

`Window.partitionBy(stream).orderBy(t)` puts a whole recording into one task. These operators cut each stream into buckets
that follow each other in time (all rows of one time in one bucket), summarise the buckets, carry the summaries forward over
the few rows they are, and run the window inside a bucket alone. Rows whose key is null are one stream of their own.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions.shared import dropped, stored

ROWS_PER_BUCKET = 1_000_000


def bucketed(df: DataFrame, keys: list[str], time: str, buckets: int | None = None, name: str = "_bucket") -> DataFrame:
    """`df` with a bucket number that grows with time inside each key, as a stored table: every reader sees the same cuts.

    Rows are range-partitioned by key and time, so the sample behind the cuts balances long and short streams and dense
    bursts alike, and finding a row's bucket is a binary search."""
    n = buckets or max(1, math.ceil(df.count() / ROWS_PER_BUCKET))
    if n == 1:
        return df.withColumn(name, F.lit(0))
    return stored(df.repartitionByRange(n, *keys, time).withColumn(name, F.spark_partition_id()), "buckets")


def with_lead(df: DataFrame, keys: list[str], time: str, lead: int, name: str = "_bucket") -> DataFrame:
    """A bucketed `df` (of keys, time and more) with `_own`, and copies (not own) of the rows at most `lead` before each bucket's
    start. Rows and starts meet by cells of that width, of which a start has two."""
    starts = df.groupBy(*keys, name).agg(F.min(time).alias("_start")).withColumnRenamed(name, "_to")
    cell = lambda c: F.floor(F.col(c) / lead)
    starts = starts.withColumn("_cell", F.explode(F.array(cell("_start") - 1, cell("_start"))))
    near = null_safe(df.withColumn("_cell", cell(time)), starts, [*keys, "_cell"])
    copies = near.filter((F.col(name) < F.col("_to")) & (F.col(time) >= F.col("_start") - lead)).withColumns({name: F.col("_to"), "_own": F.lit(False)})
    return df.withColumn("_own", F.lit(True)).unionByName(copies.select(*df.columns, "_own"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on `keys` in which null equals null; the keys come from the left."""
    own = {k: f"_right_{k}" for k in keys}
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(o)) for k, o in own.items()))
    return left.join(right.withColumnsRenamed(own), same, how).drop(*own.values())


def running(df: DataFrame, keys: list[str], order: list[str], how: str, value: Column, out: str, buckets: int | None = None, bucket: str | None = None, exclusive: bool = False) -> DataFrame:
    """`df` with the running sum, max or last non-null `value` up to and including each row (or before it), by (keys, order).

    `bucket` names a column that already orders the rows coarsely (a packet number); else time buckets are made."""
    rows = df.withColumn("_bucket", F.col(bucket)) if bucket else bucketed(df, keys, order[0], buckets)
    rows = rows.withColumn("_v", value)
    place = F.struct(*order)
    total = {"sum": F.sum("_v"), "max": F.max("_v"), "last": F.max_by("_v", F.when(F.col("_v").isNotNull(), place))}[how]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
    carry = rows.groupBy(*keys, "_bucket").agg(total.alias("_v")).withColumn("_carry", fold("_v").over(before)).drop("_v")
    local = fold("_v").over(inside)
    both = {"sum": F.coalesce(local, F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0)), "max": F.greatest(local, F.col("_carry")), "last": F.coalesce(local, F.col("_carry"))}[how]
    return null_safe(rows, carry, [*keys, "_bucket"]).withColumn(out, both).drop("_v", "_bucket", "_carry")


def rank(df: DataFrame, keys: list[str], order: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """0-based position of each row inside its key."""
    return running(df, keys, order, "sum", F.lit(1).cast("long"), out, buckets).withColumn(out, F.col(out) - 1)


def reached(links: DataFrame, starts: DataFrame, keys: list[str], node: list[str], to: list[str], longest: int) -> DataFrame:
    """The nodes (keys and `node` columns) on the paths that begin at `starts`, where each node of `links` has one next node (its
    `to` columns) and no path has over `longest` steps: list ranking by squaring. Each round adds what the nodes so far reach by
    2^k steps and joins the links with themselves, so the rounds grow with the logarithm of the path."""
    marks, steps = starts.select(*keys, *node), links.select(*keys, *node, *to)
    back, done = dict(zip(to, node, strict=True)), 1
    while True:
        ahead = null_safe(marks, steps, [*keys, *node]).select(*keys, *to).withColumnsRenamed(back)
        found = stored(marks.unionByName(ahead), "reached")
        done *= 2
        if done > longest:
            return found
        further = steps.select(*keys, *(F.col(c).alias(back[c]) for c in to), *(F.col(c).alias(f"_at_{c}") for c in node))
        further = null_safe(further, steps, [*keys, *node]).select(*keys, *(F.col(f"_at_{c}").alias(c) for c in node), *to)
        further = stored(further, "steps")
        if done > 2:
            dropped(marks)
            dropped(steps)
        marks, steps = found, further
