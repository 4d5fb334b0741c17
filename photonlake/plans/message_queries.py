"""Queries over topics and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonlake.functions.shared import new_folder
from photonlake.operators import flatten, inertial, routing
from photonlake.plans.register import query
from photonlake.sources import recordings
from photonlake.sources.fixtures import view

INCLUDE, EXCLUDE = "^/(en|fr|de)", "9"
GROUP = "coalesce(nullif(regexp_replace(regexp_replace(trim(topic, '/'), '[^0-9A-Za-z_/]+', '_', 'g'), '/+', '/', 'g'), ''), 'topic')"
PLAN = f"""t as (select distinct topic, msgtype from fx_topics),
    o as (select topic, 'image' as kind, concat('hand/', min(page_id)) as grp from fx_topics where page_id % 40 = 0 group by topic),
    k as (select t.topic, t.msgtype, o.grp, o.topic is not null as own, coalesce(o.kind, case regexp_extract(t.msgtype, '[^/]+$')
            when 'EventArray' then 'events' when 'Imu' then 'imu' when 'Odometry' then 'odom' when 'Image' then 'image' end) as kind
          from t left join o on t.topic = o.topic),
    r as (select topic, msgtype, kind, coalesce(grp, concat(case when kind = 'image' then 'images/' else '' end, {GROUP})) as grp,
            case when regexp_matches(topic, '{EXCLUDE}') then 'excluded' when not regexp_matches(topic, '{INCLUDE}') and not own then 'not included'
                 when kind is null then 'unknown type' end as reason from k),
    plan as (select topic, msgtype, kind, case when reason is null then grp end as "group", reason from r)"""


def topics(spark, sf_dir):
    return view(spark, sf_dir, "fx_topics")


def plan(spark, sf_dir):
    t = topics(spark, sf_dir)
    own = t.filter("page_id % 40 = 0").groupBy("topic").agg(F.concat(F.lit("hand/"), F.min("page_id")).alias("group"), F.lit("image").alias("kind"))
    return routing.plan_topics(t, own, INCLUDE, EXCLUDE)


@query(f'with {PLAN} select topic, msgtype, kind, "group", reason from plan')
def topic_plan(spark, sf_dir):
    return plan(spark, sf_dir)


@query(f"with {PLAN} select topic, msgtype, reason from plan where reason is not null")
def topic_skipped(spark, sf_dir):
    return routing.skipped_topics(plan(spark, sf_dir))


@query(f"""with t as (select distinct regexp_replace(topic, '[?].*', '?') as topic, 'a/Imu' as msgtype from fx_topics),
    u as (select topic from t union all select regexp_replace(topic, '[?]$', '_') from t where topic like '%?'),
    g as (select {GROUP} as "group", count(distinct topic) as topics from u group by 1) select "group", topics from g where topics > 1""")
def group_collisions(spark, sf_dir):
    t = topics(spark, sf_dir).select(F.regexp_replace("topic", "[?].*", "?").alias("topic"), F.lit("a/Imu").alias("msgtype"))
    twins = t.filter(F.col("topic").endswith("?")).withColumn("topic", F.regexp_replace("topic", "[?]$", "_"))
    return routing.group_collisions(routing.plan_topics(t.unionByName(twins)))


@query(f'select distinct topic, {GROUP} as "group" from fx_topics')
def sanitize_group(spark, sf_dir):
    return topics(spark, sf_dir).select("topic", routing.sanitize_group(F.col("topic")).alias("group")).distinct()


@query(f'with {PLAN} select f.topic, f.msgtype, count(*) as n, min(p."group") as "group", min(p.reason) as reason from fx_topics f join plan p on f.topic = p.topic and f.msgtype = p.msgtype group by f.topic, f.msgtype')
def topic_summary(spark, sf_dir):
    return recordings.topic_summary(topics(spark, sf_dir), plan(spark, sf_dir))


@query("select distinct msgtype from fx_topics where msgtype like 'std_msgs%'")
def unknown_types(spark, sf_dir):
    t = topics(spark, sf_dir)
    return routing.unknown_types(t, t.select("msgtype").distinct().filter(routing.kind_of(F.col("msgtype")).isNotNull()))


def messages(spark, sf_dir):
    return view(spark, sf_dir, "fx_messages")


def message_plan(df):
    return routing.plan_topics(df.withColumn("msgtype", F.lit("sensor_msgs/msg/Imu")), exclude="error")


@query("select seq, topic, coalesce(stamp_us, bag_time_us) as t, bag_time_us as bag_t from fx_messages")
def event_time(spark, sf_dir):
    return messages(spark, sf_dir).select("seq", "topic", routing.event_time().alias("t"), routing.event_time(True).alias("bag_t"))


@query("""select seq, topic, substr(topic, 2) as "group", value from fx_messages where topic not like '%error%'""")
def route(spark, sf_dir):
    m = messages(spark, sf_dir)
    return routing.route(m, message_plan(m)).select("seq", "topic", "group", "value")


@query("""select substr(topic, 2) as "group", count(*) as n from fx_messages where topic not like '%error%' group by 1""")
def dataset_counts(spark, sf_dir):
    m = messages(spark, sf_dir)
    return recordings.dataset_counts(routing.route(m, message_plan(m)))


@query("""with m as (select substr(topic, 2) as "group", seq, bag_time_us, case when seq % 7 = 0 then null else concat('u', user_id) end as owner, concat('s', seq % 3) as sensor from fx_messages where topic not like '%error%'),
    f as (select "group", first(owner order by bag_time_us, seq) filter (owner is not null) as owner, first(sensor order by bag_time_us, seq) as sensor from m group by "group")
    select "group", 'owner' as key, owner as value from f union all select "group", 'sensor', sensor from f
    union all select '', key, value from (values ('source', 'events'), ('time_unit', 'microseconds'), ('time_source', 'header')) as r(key, value)""")
def manifest(spark, sf_dir):
    m = messages(spark, sf_dir)
    own = routing.route(m, message_plan(m)).withColumns({"owner": F.when(F.col("seq") % 7 != 0, F.concat(F.lit("u"), F.col("user_id"))), "sensor": F.concat(F.lit("s"), F.col("seq") % 3)})
    return recordings.dataset_manifest(own, ["owner", "sensor"], recordings.root_attributes("events", False))


@query("""select topic, seq, bag_time_us, value from (select *, row_number() over (partition by topic order by bag_time_us desc, seq desc) as r from fx_messages) where r = 1""")
def latest_per_stream(spark, sf_dir):
    return inertial.latest_per_stream(messages(spark, sf_dir).select("topic", "seq", "bag_time_us", "value"), ["topic"], ["bag_time_us", "seq"])


@query("select seq, event_id % 10 as code, ['TIMESTAMP_RESET', 'EXTERNAL_SIGNAL_RISING_EDGE', 'EXTERNAL_SIGNAL_FALLING_EDGE', 'EXTERNAL_SIGNAL_PULSE', 'EXTERNAL_GENERATOR_RISING_EDGE', 'EXTERNAL_GENERATOR_FALLING_EDGE', 'APS_FRAME_START', 'APS_FRAME_END', 'APS_EXPOSURE_START', 'APS_EXPOSURE_END'][event_id % 10 + 1] as label from (select event_id as seq, event_id from events)")
def trigger_label(spark, sf_dir):
    return view(spark, sf_dir, "fx_messages").select("seq", (F.col("seq") % 10).alias("code")).withColumn("label", flatten.trigger_label(F.col("code").cast("int")))


@query("select seq, t // 1000000 as sec, t % 1000000 * 1000 as nanosec, t as back from fx_events")
def time_struct(spark, sf_dir):
    df = view(spark, sf_dir, "fx_events").withColumn("s", flatten.us_to_time(F.col("t")))
    return df.select("seq", F.col("s.sec").cast("long").alias("sec"), "s.nanosec", flatten.time_to_us(F.col("s.sec"), F.col("s.nanosec")).alias("back"))


def nested(spark, sf_dir, name, **fields):
    """fx rows with a nested `msg` made of SQL expressions."""
    return view(spark, sf_dir, name).withColumns({"msg": F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"), "bag_time_us": F.col("t")})


XYZ = "named_struct('x', {}, 'y', {}, 'z', {})"
QUAT = "named_struct('x', qx, 'y', qy, 'z', qz, 'w', qw)"


@query("select stream, seq, t, ax, ay, az, wx, wy, wz, 0.0::double as qx, wx / 4 as qy, 0.0::double as qz, 1.0::double as qw from fx_imu")
def flatten_imu(spark, sf_dir):
    df = nested(spark, sf_dir, "fx_imu", linear_acceleration=XYZ.format("ax", "ay", "az"), angular_velocity=XYZ.format("wx", "wy", "wz"), orientation="named_struct('x', 0d, 'y', wx / 4, 'z', 0d, 'w', 1d)")
    return flatten.flatten_imu(df)


@query("select stream, seq, t, qx * 2 as px, qy as py, qz as pz, qx, qy, qz, qw, qw as vx, qx as vy, qy as vz, qz as avx, qy as avy, qx as avz from fx_odom")
def flatten_odom(spark, sf_dir):
    pose = f"named_struct('pose', named_struct('position', {XYZ.format('qx * 2', 'qy', 'qz')}, 'orientation', {QUAT}))"
    twist = f"named_struct('twist', named_struct('linear', {XYZ.format('qw', 'qx', 'qy')}, 'angular', {XYZ.format('qz', 'qy', 'qx')}))"
    return flatten.flatten_odom(nested(spark, sf_dir, "fx_odom", pose=pose, twist=twist))


@query("select stream, seq, t, case seq % 3 when 0 then qx when 1 then qy else qz end as px, qy as py, qz as pz, qx, qy, qz, qw from fx_odom")
def flatten_pose(spark, sf_dir):
    pose = lambda x: f"named_struct('position', {XYZ.format(x, 'qy', 'qz')}, 'orientation', {QUAT})"
    moved = f"if(seq % 3 = 0, named_struct('translation', {XYZ.format('qx', 'qy', 'qz')}, 'rotation', {QUAT}), null)"
    return flatten.flatten_pose(nested(spark, sf_dir, "fx_odom", transform=moved, posed=f"if(seq % 3 = 1, named_struct('pose', {pose('qy')}), null)", pose=f"if(seq % 3 = 2, {pose('qz')}, null)"))


@query("select stream, seq, t, rng as range, min_range, max_range, 0.5::double as field_of_view, (seq % 2)::int as radiation_type from fx_range")
def flatten_range(spark, sf_dir):
    df = nested(spark, sf_dir, "fx_range", range="rng", min_range="min_range", max_range="max_range", field_of_view="0.5d", radiation_type="cast(seq % 2 as int)")
    return flatten.flatten_range(df)


@query("select stream, seq, t, qx as latitude, qy as longitude, qz as altitude, (seq % 3)::int as status, 1 as service from fx_odom")
def flatten_navsat(spark, sf_dir):
    return flatten.flatten_navsat(nested(spark, sf_dir, "fx_odom", latitude="qx", longitude="qy", altitude="qz", status="named_struct('status', cast(seq % 3 as int), 'service', 1)"))


@query("select stream, seq, t, ax as mx, ay as my, az as mz from fx_imu")
def flatten_magnetic(spark, sf_dir):
    return flatten.flatten_magnetic(nested(spark, sf_dir, "fx_imu", magnetic_field=XYZ.format("ax", "ay", "az")))


@query("select stream, seq, t, case seq % 4 when 0 then ax when 1 then ay when 2 then az else wx end as value, case when seq % 5 = 0 then 0.0::double else wy end as variance from fx_imu")
def flatten_sensor_scalar(spark, sf_dir):
    df = nested(spark, sf_dir, "fx_imu", temperature="ax", fluid_pressure="ay", relative_humidity="az", illuminance="wx", variance="if(seq % 5 = 0, null, wy)")
    kinds = F.array(*map(F.lit, flatten.READINGS))
    return flatten.flatten_sensor_scalar(df.withColumn("msgtype", F.get(kinds, (F.col("seq") % 4).cast("int"))))


@query("select stream, seq, t, concat_ws(',', round(ax)::int, round(ay)::int) as data, case when seq % 2 = 0 then '2' else '1,2' end as shape from fx_imu")
def multiarray_shape(spark, sf_dir):
    dims = "if(seq % 2 = 0, cast(array() as array<struct<size:int>>), array(named_struct('size', 1), named_struct('size', 2)))"
    df = nested(spark, sf_dir, "fx_imu", data="array(cast(round(ax) as int), cast(round(ay) as int))", layout=f"named_struct('dim', {dims})")
    out = flatten.flatten_multiarray(df)
    return out.withColumns({"data": F.array_join(F.col("data").cast("array<string>"), ","), "shape": F.array_join(F.col("shape").cast("array<string>"), ",")})


@query("select stream, seq, t, wx as value from fx_imu")
def flatten_scalar(spark, sf_dir):
    return flatten.flatten_scalar(nested(spark, sf_dir, "fx_imu", data="wx"))


@query("""select substr(topic, 2) as "group", seq, bag_time_us as t, value from fx_messages where topic in ('/click', '/view')""")
def dataset_write(spark, sf_dir):
    """Routed messages written as a dataset, and two of its groups read back."""
    m = messages(spark, sf_dir)
    out = new_folder(spark, "dataset")
    rows = routing.route(m, message_plan(m)).withColumns({"stream": F.col("user_id") % 4, "t": F.col("bag_time_us")})
    recordings.write_dataset(rows.select("group", "stream", "t", "seq", "value"), out)
    return spark.read.parquet(out).filter(F.col("group").isin("click", "view")).select("group", "seq", "t", "value")


@query("select topic, seq, bag_time_us, value from fx_messages where topic in ('/signup', '/error')")
def read_messages(spark, sf_dir):
    out = new_folder(spark, "messages")
    messages(spark, sf_dir).write.partitionBy("topic").parquet(out)
    return recordings.read_messages(spark, out, ["/signup", "/error"]).select("topic", "seq", "bag_time_us", "value")
