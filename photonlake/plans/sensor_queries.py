"""Queries over inertial samples, odometry and ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonlake.operators import align, inertial
from photonlake.plans.event_queries import BUCKETS, r6
from photonlake.plans.register import query
from photonlake.sources.fixtures import view

AXES = ("ax", "ay", "az", "wx", "wy", "wz")


def imu(spark, sf_dir):
    return view(spark, sf_dir, "fx_imu")


def odom(spark, sf_dir):
    return view(spark, sf_dir, "fx_odom")


def ranges(spark, sf_dir):
    return view(spark, sf_dir, "fx_range")


@query("select seq, " + ", ".join(f"{c} * 9.81007::double as {c}" if c[0] == "a" else f"round({c} * pi() / 180, 6) as {c}" for c in AXES) + " from fx_imu")
def imu_si(spark, sf_dir):
    return r6(inertial.imu_si_units(imu(spark, sf_dir)), "wx", "wy", "wz").select("seq", *AXES)


@query("""with b as (select stream, avg(ax) as b, avg(wx) as w from fx_imu group by stream)
    select seq, round(ax - case when i.stream < 2 then 0.8223 else b end, 6) as ax, round(wx - case when i.stream < 2 then -0.00838 else w end, 6) as wx from fx_imu i join b on i.stream = b.stream""")
def imu_unbias(spark, sf_dir):
    df = imu(spark, sf_dir)
    means = df.groupBy("stream").agg(*(F.avg(c).alias(f"b_{c}") for c in AXES))
    user = means.filter("stream < 2").select("stream", *(F.lit({"ax": 0.8223, "wx": -0.00838}.get(c, 0.0)).alias(f"b_{c}") for c in AXES))
    return r6(inertial.imu_unbias(df, means, user), "ax", "wx").select("seq", "ax", "wx")


@query("select seq, round(-ay, 6) as ax, round(ax, 6) as ay, round(az, 6) as az, round(-wy, 6) as wx, round(wx, 6) as wy, round(wz, 6) as wz from fx_imu")
def imu_rotate(spark, sf_dir):
    """A quarter turn about z."""
    turned = inertial.imu_rotate(imu(spark, sf_dir), (0.5**0.5, 0.0, 0.0, 0.5**0.5))
    return turned.select("seq", *(F.round(F.round(c, 6) + 0.0, 6).alias(c) for c in AXES))


@query("select seq, t + 1500 as t from fx_imu")
def imu_offset(spark, sf_dir):
    return inertial.add_time(imu(spark, sf_dir), 1500).select("seq", "t")


@query("with o as (select stream, min(t) as offset_us from fx_imu where stream < 4 group by stream) select seq, t + coalesce(offset_us, 0) as t from fx_imu i left join o on i.stream = o.stream")
def stream_offset(spark, sf_dir):
    df = imu(spark, sf_dir)
    return inertial.stream_time_offset(df, df.filter("stream < 4").groupBy("stream").agg(F.min("t").alias("offset_us"))).select("seq", "t")


@query("""with w as (select stream, seq, t, count(*) over v as n, min(t) over v as a from fx_imu window v as (partition by stream order by t range between 1000000 preceding and current row))
    select stream, seq, t, case when n >= 2 and t > a then round((n - 1) / ((t - a) / 1000000), 6) end as rate_hz from w""")
def rate_hz(spark, sf_dir):
    return r6(inertial.rate_hz(imu(spark, sf_dir), buckets=BUCKETS), "rate_hz")


@query("""with d as (select seq, (t - lag(t) over (partition by stream order by t, seq)) / 1000000 as dt from fx_imu)
    select seq, round(dt, 6) as dt, coalesce(dt > 0 and dt < 0.1, false) as valid from d""")
def valid_dt(spark, sf_dir):
    return r6(inertial.valid_dt(imu(spark, sf_dir)), "dt").select("seq", "dt", "valid")


#: The complementary filter as a recursion over each stream's samples.
ATTITUDE = """s as (select stream, seq, t, row_number() over (partition by stream order by t, seq) as rn, t - lag(t) over (partition by stream order by t, seq) as step,
        ax * 9.81007::double as ax, ay * 9.81007::double as ay, az * 9.81007::double as az, wx * (pi() / 180) as wx, wy * (pi() / 180) as wy, wz * (pi() / 180) as wz from fx_imu),
    g as (select stream, 0::bigint as rn, null::bigint as seq, null::bigint as t, 1::double as w, 0::double as x, 0::double as y, 0::double as z, 0::double as b1, 0::double as b2, 0::double as b3 from (select distinct stream from s)
      union all
      select stream, rn, seq, t, n0 / size, n1 / size, n2 / size, n3 / size, b1, b2, b3 from (select *, sqrt(n0 * n0 + n1 * n1 + n2 * n2 + n3 * n3) as size
      from (select stream, rn, seq, t, b1, b2, b3, w + 0.5 * dt * -(x * g1 + y * g2 + z * g3) as n0, x + 0.5 * dt * (w * g1 + y * g3 - z * g2) as n1, y + 0.5 * dt * (w * g2 + z * g1 - x * g3) as n2, z + 0.5 * dt * (w * g3 + x * g2 - y * g1) as n3
      from (select *, case when pulled then wx + 2 * e1 + b1 else wx end as g1, case when pulled then wy + 2 * e2 + b2 else wy end as g2, case when pulled then wz + 2 * e3 + b3 else wz end as g3
      from (select stream, rn, seq, t, dt, pulled, w, x, y, z, wx, wy, wz, e1, e2, e3, case when pulled then c1 + 0.005 * dt * e1 else c1 end as b1, case when pulled then c2 + 0.005 * dt * e2 else c2 end as b2, case when pulled then c3 + 0.005 * dt * e3 else c3 end as b3
      from (select *, -ay / norm * v3 + az / norm * v2 as e1, -az / norm * v1 + ax / norm * v3 as e2, -ax / norm * v2 + ay / norm * v1 as e3
      from (select s.*, case when step > 0 and step < 100000 then step / 1000000 else 0 end as dt, sqrt(ax * ax + ay * ay + az * az) as norm, sqrt(ax * ax + ay * ay + az * az) > 1 and coalesce(step > 0 and step < 100000, false) as pulled,
          g.w, g.x, g.y, g.z, g.b1 as c1, g.b2 as c2, g.b3 as c3, 2 * (g.x * g.y + g.w * g.z) as v1, g.w * g.w - g.x * g.x + g.y * g.y - g.z * g.z as v2, 2 * (g.y * g.z - g.w * g.x) as v3
        from g join s on s.stream = g.stream and s.rn = g.rn + 1)))))))"""
TURNED = "select stream, seq, t, round(w, 6) as qw, round(x, 6) as qx, round(y, 6) as qy, round(z, 6) as qz from g where rn > 0"
QUATERNION = ("qw", "qx", "qy", "qz")


@query(f"with recursive {ATTITUDE} {TURNED}")
def attitude(spark, sf_dir):
    return r6(inertial.attitude(inertial.imu_si_units(imu(spark, sf_dir))), *QUATERNION)


@query(f"with recursive {ATTITUDE} {TURNED}")
def attitude_in_buckets(spark, sf_dir):
    """The same with every stream cut in time, and too short a lead for the bias to be known: buckets are run again."""
    return r6(inertial.attitude(inertial.imu_si_units(imu(spark, sf_dir)), 2 * BUCKETS, 1_000_000), *QUATERNION)


@query("""with d as (select seq, qw, qx, qy, qz, 2 * (qx * qy + qw * qz) as a, qw * qw - qx * qx + qy * qy - qz * qz as b, 2 * (qy * qz - qw * qx) as c from fx_odom)
    select seq, round(atan2(-a, b), 6) as roll, round(atan2(c, sqrt(a * a + b * b)), 6) as pitch, round(atan2(2 * (qw * qy - qx * qz), 1 - 2 * (qx * qx + qy * qy)), 6) as yaw from d""")
def euler(spark, sf_dir):
    return r6(inertial.with_euler(odom(spark, sf_dir)), "roll", "pitch", "yaw").select("seq", "roll", "pitch", "yaw")


@query("select i.stream, seq, round((t - t0) / 1000000, 6) as elapsed from fx_imu i join (select stream, min(t) as t0 from fx_imu group by stream) o on i.stream = o.stream")
def elapsed(spark, sf_dir):
    return r6(inertial.elapsed_seconds(imu(spark, sf_dir)).select("stream", "seq", "elapsed"), "elapsed")


VALID = "r as (select * from fx_range where rng > 0 and (max_range <= min_range or (rng >= min_range and rng <= max_range)))"
GRAVITY = "g as (select *, 2 * (qy * qz + qw * qx) / n as gx, (qw * qw - qx * qx - qy * qy + qz * qz) / n as gy, 2 * (qw * qy - qx * qz) / n as gz from (select *, qw * qw + qx * qx + qy * qy + qz * qz as n from fx_odom))"


@query(f"with {VALID} select stream, seq, t, rng from r")
def valid_ranges(spark, sf_dir):
    return align.valid_ranges(ranges(spark, sf_dir)).select("stream", "seq", "t", "rng")


@query(f"with {VALID} select o.stream, o.seq, o.t, r.rng, r.t as value_t from fx_odom o asof left join r on o.stream = r.stream and o.t >= r.t")
def asof_height(spark, sf_dir):
    return align.asof_backward(odom(spark, sf_dir).select("stream", "seq", "t"), align.valid_ranges(ranges(spark, sf_dir)), "rng", BUCKETS)


@query(f"with {GRAVITY} select seq, round(gx, 6) as gx, round(gy, 6) as gy, round(gz, 6) as gz from g")
def gravity(spark, sf_dir):
    return r6(align.gravity_direction(odom(spark, sf_dir)), "gx", "gy", "gz").select("seq", "gx", "gy", "gz")


@query(f"""with {GRAVITY}, e as (select * from fx_events where seq % 5 = 0),
    b as (select e.stream, e.seq, e.t, g.t as bt, g.gy as bv from e asof left join g on e.stream = g.stream and e.t >= g.t),
    f as (select e.seq, g.t as ft, g.gy as fv from e asof left join g on e.stream = g.stream and e.t <= g.t),
    n as (select b.stream, b.seq, b.t, case when ft is null or b.t - bt <= ft - b.t then bt else ft end as nt, case when ft is null or b.t - bt <= ft - b.t then bv else fv end as nv from b join f on b.seq = f.seq)
    select stream, seq, t, case when abs(nt - t) <= 4000 then round(nv, 6) end as gy, case when abs(nt - t) <= 4000 then nt end as value_t from n""")
def nearest_attitude(spark, sf_dir):
    left = view(spark, sf_dir, "fx_events").filter("seq % 5 = 0").select("stream", "seq", "t")
    return r6(align.asof_nearest(left, align.gravity_direction(odom(spark, sf_dir)), "gy", 4000, buckets=BUCKETS), "gy")


@query("select a.stream, a.seq as a_seq, b.seq as b_seq, a.t as a_t, b.t as b_t from fx_events a join fx_range b on a.stream = b.stream and abs(a.t - b.t) <= 3000")
def interval_match(spark, sf_dir):
    return align.interval_match(view(spark, sf_dir, "fx_events"), ranges(spark, sf_dir), 3000)


@query(f"with {VALID}, {GRAVITY} select r.stream, r.seq, r.t, round(r.rng * coalesce(g.gy, 1), 6) as height from r asof left join g on r.stream = g.stream and r.t >= g.t")
def vertical_height(spark, sf_dir):
    return r6(align.vertical_height(ranges(spark, sf_dir), odom(spark, sf_dir), BUCKETS), "height").select("stream", "seq", "t", "height")
