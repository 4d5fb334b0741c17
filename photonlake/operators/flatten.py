"""Nested messages as flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trigger codes.
TRIGGERS = {
    0: "TIMESTAMP_RESET", 1: "EXTERNAL_SIGNAL_RISING_EDGE", 2: "EXTERNAL_SIGNAL_FALLING_EDGE", 3: "EXTERNAL_SIGNAL_PULSE",
    4: "EXTERNAL_GENERATOR_RISING_EDGE", 5: "EXTERNAL_GENERATOR_FALLING_EDGE", 6: "APS_FRAME_START", 7: "APS_FRAME_END",
    8: "APS_EXPOSURE_START", 9: "APS_EXPOSURE_END",
}
#: Which field of a sensor message holds the reading.
READINGS = {"Temperature": "temperature", "FluidPressure": "fluid_pressure", "RelativeHumidity": "relative_humidity", "Illuminance": "illuminance"}
KEYS = ("stream", "seq", "t")


def time_to_us(sec: Column, nanosec: Column) -> Column:
    """Whole microseconds of a (seconds, nanoseconds) time, the rest cut off."""
    return (sec.cast("long") * 1_000_000 + F.floor(nanosec.cast("long") / 1000)).cast("long")


def us_to_time(us: Column) -> Column:
    sec = F.floor(us / 1_000_000).cast("long")
    return F.struct(sec.cast("int").alias("sec"), ((us - sec * 1_000_000) * 1000).cast("long").alias("nanosec"))


def explode_packets(packets: DataFrame) -> DataFrame:
    """One row for each event of each packet; empty packets give none. `pos` counts inside the packet."""
    rows = packets.select("stream", "packet_id", F.posexplode("events").alias("pos", "e"))
    return rows.select("stream", "packet_id", "pos", *(F.col(f"e.{c}").alias(c) for c in ("t", "seq", "x", "y", "p")))


def packetize(events: DataFrame, width_us: int = 1000) -> DataFrame:
    """The events of each interval as one packet, in order; its time is that of its last event."""
    packet = F.floor(F.col("t") / width_us).alias("packet_id")
    return events.groupBy("stream", packet).agg(F.array_sort(F.collect_list(F.struct("t", "seq", "x", "y", "p"))).alias("events"), F.max("t").alias("t"))


def _pick(df: DataFrame, **fields: str) -> DataFrame:
    return df.select(*(c for c in KEYS if c in df.columns), *(F.col(path).alias(name) for name, path in fields.items()))


def flatten_imu(df: DataFrame) -> DataFrame:
    a, w, q = "msg.linear_acceleration", "msg.angular_velocity", "msg.orientation"
    return _pick(df, ax=f"{a}.x", ay=f"{a}.y", az=f"{a}.z", wx=f"{w}.x", wy=f"{w}.y", wz=f"{w}.z", qx=f"{q}.x", qy=f"{q}.y", qz=f"{q}.z", qw=f"{q}.w")


def flatten_odom(df: DataFrame) -> DataFrame:
    p, q, v, a = "msg.pose.pose.position", "msg.pose.pose.orientation", "msg.twist.twist.linear", "msg.twist.twist.angular"
    return _pick(df, px=f"{p}.x", py=f"{p}.y", pz=f"{p}.z", qx=f"{q}.x", qy=f"{q}.y", qz=f"{q}.z", qw=f"{q}.w", vx=f"{v}.x", vy=f"{v}.y", vz=f"{v}.z", avx=f"{a}.x", avy=f"{a}.y", avz=f"{a}.z")


def flatten_pose(df: DataFrame) -> DataFrame:
    """`transform` (translation, rotation), else `posed` (a pose with covariance), else `pose`; each may be null."""
    first = lambda t, p: F.coalesce(f"msg.transform.{t}", f"msg.posed.pose.{p}", f"msg.pose.{p}")
    cols = [first(f"translation.{c}", f"position.{c}").alias(f"p{c}") for c in "xyz"] + [first(f"rotation.{c}", f"orientation.{c}").alias(f"q{c}") for c in "xyzw"]
    return df.select(*KEYS, *cols)


def flatten_range(df: DataFrame) -> DataFrame:
    return _pick(df, range="msg.range", min_range="msg.min_range", max_range="msg.max_range", field_of_view="msg.field_of_view", radiation_type="msg.radiation_type")


def flatten_navsat(df: DataFrame) -> DataFrame:
    return _pick(df, latitude="msg.latitude", longitude="msg.longitude", altitude="msg.altitude", status="msg.status.status", service="msg.status.service")


def flatten_magnetic(df: DataFrame) -> DataFrame:
    return _pick(df, mx="msg.magnetic_field.x", my="msg.magnetic_field.y", mz="msg.magnetic_field.z")


def flatten_sensor_scalar(df: DataFrame) -> DataFrame:
    """The reading that the message's type names; a missing variance is 0."""
    value = F.coalesce(*(F.when(F.col("msgtype") == t, F.col(f"msg.{f}")) for t, f in READINGS.items()))
    return df.select(*KEYS, value.alias("value"), F.coalesce("msg.variance", F.lit(0.0)).alias("variance"))


def flatten_multiarray(df: DataFrame) -> DataFrame:
    """Ragged data with its shape; without dimensions, the number of values. Time of receipt is the only clock."""
    shape = F.transform("msg.layout.dim", lambda d: d["size"].cast("int"))
    return df.select("stream", "seq", F.col("bag_time_us").alias("t"), F.col("msg.data").alias("data"), F.when(F.size(shape) > 0, shape).otherwise(F.array(F.size("msg.data"))).alias("shape"))


def flatten_scalar(df: DataFrame, kind: str = "double") -> DataFrame:
    return df.select("stream", "seq", F.col("bag_time_us").alias("t"), F.col("msg.data").cast(kind).alias("value"))


def trigger_label(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in TRIGGERS.items() for x in kv))[code]
