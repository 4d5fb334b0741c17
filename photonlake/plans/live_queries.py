"""The streaming operators, each over all that its source folder holds now."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonlake.functions.scan import rank
from photonlake.functions.shared import new_folder
from photonlake.operators import filters, inertial, late
from photonlake.plans.event_queries import BUCKETS, SHAKEN, SUPPORTED, WIDTH_US, r6
from photonlake.plans.frame_queries import FITS, PLANTED, fits, gated_sql
from photonlake.plans.register import query
from photonlake.plans.sensor_queries import ATTITUDE, QUATERNION, TURNED
from photonlake.sources.fixtures import view
from photonlake.streaming import live


PARTS, PART_US = 6, 4_500_000


def arriving(spark, df, part, parts=PARTS):
    """`df` as a stream of `parts` micro-batches: a folder of files for each value of the column, in that order of age."""
    path = new_folder(spark, "arriving")
    df.withColumn("part", part.cast("int")).repartition(parts, "part").write.partitionBy("part").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for number in range(parts + 1):
        folder = hadoop.Path(f"{path}/part={number}")
        system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(folder):
            for status in system.listStatus(folder):
                system.setTimes(status.getPath(), 1_600_000_000_000 + 60_000 * number, -1)
    return live.scan(spark, path, spark.read.parquet(path).schema, 1).drop("part")


def source(spark, sf_dir, name, time="t"):
    """A fixture view as a stream that arrives in six parts by time."""
    return arriving(spark, view(spark, sf_dir, name), F.floor(F.col(time) / PART_US))


def swapped(part):
    """Parts 0 to 5 in the order 1, 0, 3, 2, 5, 4."""
    return part + 1 - 2 * (part % 2)


def shuffled(spark, sf_dir, name):
    """A fixture view as a stream whose parts arrive in the wrong order, up to two parts late."""
    return arriving(spark, view(spark, sf_dir, name), swapped(F.floor(F.col("t") / PART_US)))


#: The delay that shuffled parts need, and the rows that the last watermark lets go.
DELAY = "10 seconds"
SETTLED = "(select max(t) // 1000 * 1000 - 10000000 from {})"


@query("""select stream, t // 50000 as win, y, x, sum(p)::bigint as n_on, sum(1 - p)::bigint as n_off from fx_events
    where (t // 50000 + 1) * 50000 <= (select max(t) // 1000 * 1000 from fx_events) group by all""")
def stream_tumbling(spark, sf_dir):
    return live.drained(live.tumbling_counts(source(spark, sf_dir, "fx_events"), WIDTH_US), "tumbling")


@query("""with s as (select *, t // 1000 * 1000 as ms from fx_imu), e as (select stream, t, unnest(range(t // 100000 * 100000 + 100000, t // 100000 * 100000 + 1100000, 100000)) as t_end from fx_imu)
    select stream, t_end, case when count(*) >= 2 and max(t) > min(t) then round((count(*) - 1) / ((max(t) - min(t)) / 1000000), 6) end as rate_hz from e
    where t_end <= (select max(ms) from s) group by stream, t_end""")
def stream_rate(spark, sf_dir):
    return r6(live.drained(live.sliding_rate(source(spark, sf_dir, "fx_imu")), "rate"), "rate_hz")


@query(f"""with e as (select *, t // {PART_US} + case when seq % 10 = 0 and t // {PART_US} < {PARTS - 3} then 3 else 0 end as part from fx_events),
    m as (select part + 2 as part, max(max(t // 1000 * 1000)) over (order by part) as mark from e group by part)
    select stream, seq, e.t, x, y, p from e left join m on e.part = m.part where mark is null or e.t > mark""")
def stream_on_time(spark, sf_dir):
    """Every tenth event arrives three parts late: such events go. A batch drops what is behind the watermark that the batch
    before it began with."""
    late = F.when((F.col("seq") % 10 == 0) & (F.floor(F.col("t") / PART_US) < PARTS - 3), 3).otherwise(0)
    stream = arriving(spark, view(spark, sf_dir, "fx_events"), F.floor(F.col("t") / PART_US) + late)
    return live.drained(live.on_time(stream).select("stream", "seq", "t", "x", "y", "p"), "on-time")


#: Packets of 100 ms, whose arrival is shaken by up to three packets, and which of them are accepted.
ACCEPTED = """p as (select stream, t // 100000 as packet_id, min(t) as t_lo, max(t) as t_hi from fx_events group by 1, 2),
    o as (select *, row_number() over (partition by stream order by packet_id + packet_id * 7 % 4 * 1.25) as rn from p),
    g as (select stream, 0::bigint as rn, null::bigint as packet_id, null::bigint as t_lo, null::bigint as newest, false as accepted from (select distinct stream from o)
      union all select o.stream, o.rn, o.packet_id, o.t_lo, case when newest is null or o.t_lo >= newest then t_hi else newest end, newest is null or o.t_lo >= newest from g join o on o.stream = g.stream and o.rn = g.rn + 1)"""


def arrived(spark, sf_dir):
    e = view(spark, sf_dir, "fx_events").withColumn("packet_id", F.floor(F.col("t") / 100_000))
    p = e.groupBy("stream", "packet_id").agg(F.min("t").alias("t_lo"), F.max("t").alias("t_hi"))
    return p.withColumn("seq", F.col("packet_id") + F.pmod(F.col("packet_id") * 7, F.lit(4)) * 1.25)


@query(f"with recursive {ACCEPTED} select stream, packet_id, accepted from g where rn > 0")
def late_packets(spark, sf_dir):
    return late.late_packets(arrived(spark, sf_dir), BUCKETS)


@query(f"""with recursive {ACCEPTED}, w as (select max(t_lo) // 1000 * 1000 - 10000000 as mark from p), c as (select stream, min(rn) as cut from g join w on t_lo + 500000 > mark where rn > 0 group by stream)
    select g.stream, packet_id, accepted from g left join c on g.stream = c.stream where rn > 0 and (cut is null or rn < cut)""")
def stream_late_packets(spark, sf_dir):
    """The same on a stream whose files come in the wrong order: what the last watermark lets go."""
    stream = arriving(spark, arrived(spark, sf_dir), swapped(F.floor(F.col("t_lo") / PART_US)))
    return live.drained(live.late_packets(stream, DELAY, 500_000), "late")


@query(f"{SUPPORTED} and e.t <= {SETTLED.format('fx_events')}")
def stream_noise_filter(spark, sf_dir):
    return live.drained(live.noise_filter(shuffled(spark, sf_dir, "fx_events"), 200_000, DELAY).select("stream", "seq", "t", "x", "y", "p"), "noise")


@query(f"with recursive {ATTITUDE} {TURNED} and t <= {SETTLED.format('fx_imu')}")
def stream_attitude(spark, sf_dir):
    return r6(live.drained(live.attitude(inertial.imu_si_units(shuffled(spark, sf_dir, "fx_imu")), DELAY), "attitude"), *QUATERNION)


@query(f"""with {SHAKEN}, c as (select stream, min(seq) as cut from s where raw_t + 80000 > (select max(raw_t) // 1000 * 1000 - 10000000 from s) group by stream)
    select m.stream, seq, raw_t, t from m left join c on m.stream = c.stream where cut is null or seq < cut""")
def stream_packet_time(spark, sf_dir):
    """An event's time lies up to 80 ms behind that of one before it."""
    shaken = shuffled(spark, sf_dir, "fx_events").withColumn("t", F.col("t") - F.col("seq") % 5 * 20_000)
    return live.drained(live.packet_time(shaken, DELAY, 80_000), "packet-time")


@query(f"with recursive {PLANTED}, {gated_sql(FITS)} select stream, frame_id, t, round(slope, 6) as slope, shift, state, rejected from g where rn > 0 and t <= (select max(t) // 1000 * 1000 - (max(t) // 3 // 1000 + 1000) * 1000 from p)")
def stream_fit_gate(spark, sf_dir):
    most = fits(spark, sf_dir).agg(F.max("t")).first()[0] or 0
    stream = arriving(spark, fits(spark, sf_dir), swapped(F.floor(F.col("t") * PARTS / (most + 1))))
    return r6(live.drained(live.fit_gate(stream, delay=f"{most // 3 // 1000 + 1000} milliseconds"), "gate").drop("tolerance"), "slope")


@query("select topic, seq, bag_time_us, value from (select *, row_number() over (partition by topic order by bag_time_us desc, seq desc) as r from fx_messages) where r = 1")
def stream_latest(spark, sf_dir):
    return live.latest_value(source(spark, sf_dir, "fx_messages", "bag_time_us").select("topic", "seq", "bag_time_us", "value"), ["topic"], ["bag_time_us", "seq"])


@query("""with a as (select stream, seq, t from fx_events where seq % 5 = 0), p as (select a.stream, a.seq as a_seq, a.t as a_t, o.seq as b_seq, o.t as b_t,
      row_number() over (partition by a.stream, a.seq order by abs(a.t - o.t), o.t, o.seq) as r from a left join fx_odom o on a.stream = o.stream and abs(a.t - o.t) <= 4000 and o.t > 0)
    select stream, a_seq, a_t, b_seq, b_t from p where r = 1 and a_t < (select least((select max(t) from fx_events), (select max(t) from fx_odom)) - 3000000)""")
def stream_nearest(spark, sf_dir):
    """The rows up to 3 s before the shorter source's end, which the watermark has passed when the sources end."""
    left = source(spark, sf_dir, "fx_events").filter("seq % 5 = 0")
    ends = [view(spark, sf_dir, name).agg(F.max("t")).first()[0] or 0 for name in ("fx_events", "fx_odom")]
    out = live.drained(live.nearest(left, source(spark, sf_dir, "fx_odom").filter("t > 0"), 4000, "1 second"), "nearest")
    return out.filter(F.col("a_t") < min(ends) - 3_000_000)


@query(f"with w as (select *, row_number() over (partition by stream order by t, seq) - 1 as r from fx_events) select stream, r as packet_id, t, y::bigint as y, t // 16777216 as rollovers from w where t <= {SETTLED.format('fx_events')}")
def stream_full_time(spark, sf_dir):
    """Each event as three words of its own packet; the clock rolls over once. The time and y after the last word are asked for."""
    e = rank(view(spark, sf_dir, "fx_events"), ["stream"], ["t", "seq"], "packet_id", BUCKETS)
    word = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.cast("long").alias("payload"))
    words = F.array(word(8, F.floor(F.col("t") / 4096) % 4096), word(6, F.col("t") % 4096), word(0, F.col("y")))
    rows = e.select("stream", "packet_id", "t", F.posexplode(words).alias("pos", "w")).select("stream", "packet_id", F.col("pos").cast("long").alias("pos"), "t", "w.kind", "w.payload")
    return live.drained(live.full_times(arriving(spark, rows, swapped(F.floor(F.col("t") / PART_US))), DELAY), "full-time").filter("pos = 2").drop("pos")


@query("select stream, seq, t, 15 - x as x, y, p from fx_events where y > 0")
def stream_undistort(spark, sf_dir):
    grid = view(spark, sf_dir, "fx_events").select(F.concat(F.lit("cam"), F.col("stream")).alias("camera"), "x", "y").distinct()
    remap = grid.filter("y > 0").withColumns({"ux": F.lit(15) - F.col("x"), "uy": F.col("y")})
    own = source(spark, sf_dir, "fx_events").withColumn("camera", F.concat(F.lit("cam"), F.col("stream")))
    return live.drained(filters.undistort_events(own, remap).select("stream", "seq", "t", "x", "y", "p"), "undistort")


@query("select topic, seq, bag_time_us, value from fx_messages where topic in ('/click', '/view')")
def stream_record(spark, sf_dir):
    out = new_folder(spark, "recording")
    live.record(source(spark, sf_dir, "fx_messages", "bag_time_us").select("topic", "seq", "bag_time_us", "value"), ["/click", "/view"], out, new_folder(spark, "recording-state")).awaitTermination()
    return spark.read.parquet(out).select("topic", "seq", "bag_time_us", "value")
