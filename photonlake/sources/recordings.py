"""Recordings as tables: reading, writing, summaries and time ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.functions.scan import null_safe
from photonlake.functions.shared import stored


def read_messages(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """The messages of a recording. `topic` is a partition column, so wanted topics prune directories."""
    df = spark.read.parquet(path)
    return df if topics is None else df.filter(F.col("topic").isin(topics))


def write_dataset(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """One directory for each group, files range-sorted by time so that statistics serve as an index on it."""
    df.repartitionByRange("group", "stream", "t").sortWithinPartitions("group", "stream", "t", "seq").write.partitionBy("group").option("compression", compression).mode("append").parquet(path)


def dataset_manifest(df: DataFrame, attributes: list[str], root: dict[str, str] | None = None) -> DataFrame:
    """group, key, value: of every attribute the first value that any message of the group has; `root` attributes stand under
    the group ''."""
    place = lambda a: F.when(F.col(a).isNotNull(), F.struct("bag_time_us", "seq"))
    firsts = df.groupBy("group").agg(*(F.min_by(F.col(a).cast("string"), place(a)).alias(a) for a in attributes))
    pairs = ", ".join(f"'{a}', `{a}`" for a in attributes)
    out = firsts.select("group", F.expr(f"stack({len(attributes)}, {pairs}) as (key, value)")).filter("value is not null")
    return out.unionByName(df.sparkSession.createDataFrame([("", k, v) for k, v in root.items()], "group string, key string, value string")) if root else out


def root_attributes(source: str, use_bag_time: bool) -> dict[str, str]:
    """What a dataset says of itself."""
    return {"source": source, "time_unit": "microseconds", "time_source": "bag" if use_bag_time else "header"}


def dataset_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("group").agg(F.count("*").alias("n"))


def topic_summary(messages: DataFrame, plan: DataFrame) -> DataFrame:
    """Messages of each topic and type, with the group or the reason why there is none."""
    n = messages.groupBy("topic", "msgtype").agg(F.count("*").alias("n"))
    return n.join(plan.select("topic", "msgtype", "group", "reason"), ["topic", "msgtype"], "left")


def time_range(events: DataFrame, start_us: int, duration_us: int | None = None) -> DataFrame:
    """Events of each stream from its first one plus `start_us`, before that plus the duration (or to the end). The first
    times are read first; the range that holds all streams' ranges goes to the scan as constants, so that files and row
    groups outside it aren't read. An empty table gives none."""
    first = stored(events.groupBy("stream").agg(F.min("t").alias("_t0")), "starts")
    low, high = first.agg(F.min("_t0"), F.max("_t0")).first()
    if low is None:
        return events.limit(0)
    known: Column = F.col("t") >= low + start_us
    inside: Column = F.col("t") >= F.col("_t0") + start_us
    if duration_us is not None:
        known &= F.col("t") < high + start_us + duration_us
        inside &= F.col("t") < F.col("_t0") + start_us + duration_us
    return null_safe(events.filter(known), first, ["stream"]).filter(inside).drop("_t0")


def recording_span(events: DataFrame) -> DataFrame:
    return events.groupBy("stream").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t_end")).withColumn("seconds", (F.col("t_end") - F.col("t0")) / 1e6)
