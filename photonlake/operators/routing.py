"""Which messages go where: topic plans, groups, event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Message types (last part of their names) by the kind of table they become.
TYPE_KINDS = {
    "EventArray": "events", "EventPacket": "packets", "Imu": "imu", "Odometry": "odom",
    "PoseStamped": "pose", "PoseWithCovarianceStamped": "pose", "TransformStamped": "pose", "Range": "range",
    "NavSatFix": "navsat", "MagneticField": "magnetic", "Temperature": "sensor_scalar", "FluidPressure": "sensor_scalar",
    "RelativeHumidity": "sensor_scalar", "Illuminance": "sensor_scalar", "Image": "image", "CompressedImage": "image",
    "Float32MultiArray": "multiarray", "Float64MultiArray": "multiarray", "Int8MultiArray": "multiarray",
    "Int16MultiArray": "multiarray", "Int32MultiArray": "multiarray", "Int64MultiArray": "multiarray",
    "UInt8MultiArray": "multiarray", "UInt16MultiArray": "multiarray", "UInt32MultiArray": "multiarray",
    "UInt64MultiArray": "multiarray", "Bool": "scalar", "Float32": "scalar", "Float64": "scalar", "Int8": "scalar",
    "Int16": "scalar", "Int32": "scalar", "Int64": "scalar", "UInt8": "scalar", "UInt16": "scalar", "UInt32": "scalar",
    "UInt64": "scalar",
}
#: Kinds whose groups stand under a common folder.
PREFIXES = {"image": "images"}


def sanitize_group(topic: Column) -> Column:
    """A topic as a group name: no outer slashes, other characters than letters, digits and _ as _, single slashes."""
    name = F.regexp_replace(F.trim(topic, F.lit("/")), "[^0-9A-Za-z_/]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(name, "/+", "/"), F.lit("")), F.lit("topic"))


def kind_of(msgtype: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in TYPE_KINDS.items() for x in kv))
    return kinds[F.regexp_extract(msgtype, "[^/]+$", 0)]


def plan_topics(topics: DataFrame, overrides: DataFrame | None = None, include: str | None = None, exclude: str | None = None, auto: bool = True) -> DataFrame:
    """topic, msgtype, kind, group, reason for each distinct topic and type; a null reason means it is planned.

    The first rule that applies decides: excluded, not included (unless mapped by hand), not mapped, of unknown type.
    `include` and `exclude` are regular expressions that may match anywhere. `overrides`: topic, kind, group."""
    df = topics.select("topic", "msgtype").distinct()
    if overrides is None:
        df = df.withColumns({"_kind": F.lit(None).cast("string"), "_group": F.lit(None).cast("string"), "_own": F.lit(False)})
    else:
        own = overrides.select("topic", F.col("kind").alias("_kind"), F.col("group").alias("_group"), F.lit(True).alias("_own"))
        df = df.join(own, "topic", "left").withColumn("_own", F.coalesce("_own", F.lit(False)))
    kind = F.coalesce("_kind", kind_of(F.col("msgtype")))
    rule = F.when(F.col("topic").rlike(exclude), "excluded") if exclude else F.when(F.lit(False), "")
    if include:
        rule = rule.when(~F.col("topic").rlike(include) & ~F.col("_own"), "not included")
    rule = rule.when(~F.col("_own") & ~F.lit(auto), "not mapped").when(kind.isNull(), "unknown type")
    prefix = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))[kind]
    group = F.coalesce("_group", F.concat_ws("/", prefix, sanitize_group(F.col("topic"))))
    return df.select("topic", "msgtype", kind.alias("kind"), F.when(rule.isNull(), group).alias("group"), rule.alias("reason"))


def skipped_topics(plan: DataFrame) -> DataFrame:
    return plan.filter("reason is not null").select("topic", "msgtype", "reason")


def group_collisions(plan: DataFrame) -> DataFrame:
    """Groups that more than one topic claims."""
    return plan.filter("reason is null").groupBy("group").agg(F.count_distinct("topic").alias("topics")).filter("topics > 1")


def route(messages: DataFrame, plan: DataFrame) -> DataFrame:
    """Messages with their group; unplanned ones go."""
    return messages.join(plan.filter("reason is null").select("topic", "group", "kind"), "topic")


def unknown_types(topics: DataFrame, known: DataFrame) -> DataFrame:
    return topics.select("msgtype").distinct().join(known.select("msgtype"), "msgtype", "left_anti")


def event_time(use_bag_time: bool = False) -> Column:
    """The header's time, or the time of receipt where the header has none or isn't wanted."""
    return F.col("bag_time_us") if use_bag_time else F.coalesce("stamp_us", "bag_time_us")
