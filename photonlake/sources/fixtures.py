"""Views with the shape of sensor tables over the test tables, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonlake.operators import decode

#: Streams number their frames from 0 on, each its own. Time is compressed: a month becomes 26 s. {t} is the dialect's expression for it, {div} its integer division.
TEMPLATES = {
    "fx_events": """
        select event_id as seq, event_id % 4 as stream, cast(user_id % 16 as int) as x,
               cast((event_id * 7 + user_id) % 12 as int) as y, {t} as t,
               cast(case when event_type in ('click', 'purchase', 'signup') then 1 else 0 end as int) as p
        from events""",
    "fx_imu": """
        select event_id as seq, user_id % 8 as stream, {t} as t,
               cast(event_id * 37 % 1000 as double) / 100 - 5 as ax, cast(event_id * 53 % 1000 as double) / 100 - 15 as ay,
               cast(event_id * 71 % 1000 as double) / 100 - 5 as az, cast(event_id * 11 % 600 as double) / 10 - 30 as wx,
               cast(event_id * 13 % 600 as double) / 10 - 30 as wy, cast(event_id * 17 % 600 as double) / 10 - 30 as wz
        from events""",
    "fx_odom": """
        select o_orderkey as seq, o_orderkey % 4 as stream, (o_orderkey * 1733) % 26000000 as t,
               cast(1 as double) as qw, cast(o_custkey % 21 - 10 as double) / 100 as qx,
               cast(o_custkey % 17 - 8 as double) / 100 as qy, cast(o_custkey % 13 - 6 as double) / 100 as qz
        from orders""",
    "fx_range": """
        select o_orderkey as seq, o_orderkey % 4 as stream, (o_orderkey * 1733 + 500) % 26000000 as t,
               o_totalprice / 100000 as rng, cast(1 as double) / 10 as min_range, cast(4 as double) as max_range
        from orders where o_orderkey % 3 = 0""",
    "fx_pixels": """
        select vec_id {div} 4 as frame_id, vec_id % 4 as stream, vec_id * 50000 as t, cast(k {div} 8 as int) as v,
               cast(k % 8 as int) as u, cast(dd as double) + 1 as d
        from {numbered}""",
    "fx_floor": """
        select vec_id {div} 4 as frame_id, vec_id % 4 as stream, vec_id * 50000 as t, cast(k {div} 8 as int) as v, cast(k % 8 as int) as u,
               (1 + cast(vec_id % 7 as double) / 10) * (case when vec_id % 11 = 5 then 2 else 1 end) * (k {div} 8) / 8
                 - cast(1 as double) / 10 + cast(dd as double) / 50
                 + (case when k % 5 = 0 then cast(1 as double) / 2 else 0 end) as d
        from {numbered}""",
    "fx_topics": """
        select page_id, regexp_replace(url, '^https?://[^/]+', '') as topic,
               case page_id % 5 when 0 then 'event_msgs/msg/EventArray' when 1 then 'sensor_msgs/msg/Imu'
                    when 2 then 'nav_msgs/msg/Odometry' when 3 then 'sensor_msgs/msg/Image'
                    else 'std_msgs/msg/String' end as msgtype
        from pages""",
    "fx_messages": """
        select event_id as seq, concat('/', event_type) as topic, {t} + user_id as bag_time_us,
               case when event_id % 5 = 0 then null else {t} end as stamp_us, value, user_id
        from events""",
}
SPARK = {"t": "(unix_micros(cast(ts as timestamp)) - 1704067200000000) div 100000", "div": "div", "numbered": "(select vec_id, k, dd from embeddings lateral view posexplode(embedding) as k, dd)"}
DUCK = {"t": "(epoch_us(ts) - 1704067200000000) // 100000", "div": "//", "numbered": "(select vec_id, unnest(embedding) dd, unnest(range(64)) k from embeddings)"}
BASE = {"fx_events": "events", "fx_imu": "events", "fx_odom": "orders", "fx_range": "orders", "fx_pixels": "embeddings", "fx_floor": "embeddings", "fx_topics": "pages", "fx_messages": "events"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = TEMPLATES[name].format(**SPARK)
    base = BASE[name]
    return spark.sql(sql.replace(f"from {base}", "from {base}"), base=spark.read.parquet(f"{sf_dir}/{base}.parquet"))


def duck(sql: str) -> str:
    """`sql` with the fixture views it names in front of it."""
    used = [n for n in TEMPLATES if n in sql]
    head = ", ".join(f"{n} as ({TEMPLATES[n].format(**DUCK)})" for n in used)
    body = sql.strip()
    if not used:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body[:5].lower() == "with " else f"with {head} {body}"


def encoded(events: DataFrame, packet_us: int, vectors: bool = False, scale: int = 1) -> DataFrame:
    """The inverse of decoding, for round trips: binary packets from events (x below 16), one packet for each interval."""
    t = F.floor(F.col("t") / scale).cast("long")
    word = lambda kind, payload: (F.lit(kind << 12) + payload).cast("int")
    bit = lambda low, n: F.when((F.col("x") >= low) & (F.col("x") < low + n), F.expr(f"shiftleft(1, x - {low})")).otherwise(0)
    tail = [word(decode.VECT_BASE_X, F.col("p") * 2048), word(decode.VECT_12, bit(0, 12)), word(decode.VECT_8, bit(12, 8))] if vectors else [word(decode.ADDR_X, F.col("p") * 2048 + F.col("x"))]
    words = F.array(word(decode.TIME_HIGH, F.shiftright(t, 12).bitwiseAND(0xFFF)), word(decode.TIME_LOW, t.bitwiseAND(0xFFF)), word(decode.ADDR_Y, F.col("y")), *tail)
    hexed = F.array_join(F.transform(words, lambda w: F.concat(F.lpad(F.hex(w.bitwiseAND(0xFF)), 2, "0"), F.lpad(F.hex(F.shiftright(w, 8)), 2, "0"))), "")
    rows = events.select("stream", F.floor(F.col("t") / packet_us).alias("packet_id"), t.alias("t"), "seq", hexed.alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "seq", "h"))), lambda r: r["h"]), "")
    return rows.groupBy("stream", "packet_id").agg(F.unhex(joined).alias("words"), (F.min("t") * 1000).alias("time_base_ns"), F.min("t").alias("bag_time_us"), F.lit("evt3").alias("encoding"))
