"""Queries over events: windows, frames, filters, decoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from photonlake.operators import decode, filters, flatten, scoring, windows
from photonlake.plans.register import query
from photonlake.sources import recordings
from photonlake.sources.fixtures import encoded, view

WIDTH_US, W, H = 50_000, 16, 12
BUCKETS = 8
WINDOWED = "w as (select e.*, (e.t - o.t0) // 50000 as win from fx_events e join (select stream, min(t) as t0 from fx_events group by stream) o on e.stream = o.stream)"
COUNTED = WINDOWED + ", c as (select stream, win, count(*) as n from w group by stream, win)"


def events(spark, sf_dir):
    return view(spark, sf_dir, "fx_events")


def windowed(spark, sf_dir):
    return windows.tumbling(events(spark, sf_dir), WIDTH_US)


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"with {COUNTED} select stream, win, n from c")
def window_counts(spark, sf_dir):
    return windows.window_counts(windowed(spark, sf_dir))


@query(f"""with {COUNTED}, r as (select stream, win * 50000 // 5000000 as report, n from c)
    select stream, report, count(*) as windows, cast(sum(n) as bigint) as events, round(sum(n) / count(*), 6) as mean_events,
           round(count(*) / cast(5 as double), 6) as windows_per_s from r group by stream, report""")
def window_stats(spark, sf_dir):
    return r6(windows.window_stats(windowed(spark, sf_dir), WIDTH_US), "mean_events", "windows_per_s")


@query(f"with {WINDOWED} select stream, win, seq, t, x, y, p from w where win % 2 = 0")
def window_stride(spark, sf_dir):
    return windows.every_nth_window(windowed(spark, sf_dir), 2).select("stream", "win", "seq", "t", "x", "y", "p")


@query(f"with {COUNTED} select w.stream, w.win, w.seq from w join c on w.stream = c.stream and w.win = c.win where c.n >= 4")
def window_gate(spark, sf_dir):
    return windows.gate_min_events(windowed(spark, sf_dir), 4).select("stream", "win", "seq")


@query(f"with {COUNTED} select stream, sum(case when n < 4 then 1 else 0 end)::bigint as gated, count(*) as windows from c group by stream")
def window_gate_counts(spark, sf_dir):
    return windows.gated_windows(windowed(spark, sf_dir), 4)


@query(f"""with {COUNTED}, r as (select stream, win, seq, row_number() over (partition by stream, win order by t, seq) - 1 as r from w),
    k as (select stream, win, unnest(range(least(n, 3))) as i, n from c)
    select r.stream, r.win, r.seq from r join k on r.stream = k.stream and r.win = k.win
      and r.r = case when k.n > 3 then k.i * k.n // 3 else k.i end""")
def decimate(spark, sf_dir):
    return windows.decimate(windowed(spark, sf_dir), 3).select("stream", "win", "seq")


NORMAL = "f as (select stream, win, seq, x / 16 as nx, y / 12 as ny, (max(t) over (partition by stream, win) - t) / 50000 as age, p as pol from w)"


@query(f"with {WINDOWED}, {NORMAL} select stream, win, seq, round(nx, 6) as nx, round(ny, 6) as ny, round(greatest(0, least(1, age)), 6) as age, cast(pol as double) as pol from f")
def normalize_events(spark, sf_dir):
    return r6(windows.normalize_events(windowed(spark, sf_dir), W, H, WIDTH_US), "nx", "ny", "age")


@query(f"""with {WINDOWED}, {NORMAL}
    select stream, win, count(*) as n, round(first(age order by age desc, seq), 6) as oldest, round(last(age order by age desc, seq), 6) as newest,
           round(sum(nx), 6) as sum_nx, round(last(ny order by age desc, seq), 6) as last_ny from f group by stream, win""")
def pack_windows(spark, sf_dir):
    m = windows.pack_windows(windows.normalize_events(windowed(spark, sf_dir), W, H, WIDTH_US))
    at = lambda i, j: F.element_at(F.element_at("matrix", i), j)
    total = F.aggregate("matrix", F.lit(0.0), lambda s, r: s + F.element_at(r, 1))
    return r6(m.select("stream", "win", "n", at(1, 3).alias("oldest"), at(-1, 3).alias("newest"), total.alias("sum_nx"), at(-1, 2).alias("last_ny")), "oldest", "newest", "sum_nx", "last_ny")


@query(f"with {WINDOWED} select stream, win, y, x, case when min(p) = 0 then 'green' else 'red' end as colour from w group by stream, win, y, x")
def polarity_frame(spark, sf_dir):
    return windows.polarity_frame(windowed(spark, sf_dir))


@query(f"with {WINDOWED} select stream, win, y, x, sum(p)::bigint as n_on, sum(1 - p)::bigint as n_off from w group by stream, win, y, x")
def event_histogram(spark, sf_dir):
    return windows.event_histogram(windowed(spark, sf_dir))


@query(f"""with {WINDOWED}, g as (select stream, win, i, cast(coalesce(n, 0) as bigint) as n
      from (select distinct stream, win, unnest(range(192)) as i from w) left join (select stream, win, y * 16 + x as i, count(*) as n from w group by all) using (stream, win, i))
    select stream, win, string_agg(n::varchar, ',' order by i) as frame from g group by stream, win""")
def dense_frame(spark, sf_dir):
    return windows.dense_frame(windowed(spark, sf_dir), W, H).withColumn("frame", F.array_join("frame", ","))


@query("""with n as (select stream, greatest(1, count(*) // 100) as step from fx_events group by stream),
    r as (select stream, seq, t, row_number() over (partition by stream order by t, seq) - 1 as r from fx_events)
    select r.stream, r.seq, r.t from r join n on r.stream = n.stream where r.r % n.step = 0""")
def subsample(spark, sf_dir):
    return windows.subsample(events(spark, sf_dir), 100, BUCKETS).select("stream", "seq", "t")


@query(f"with {WINDOWED} select stream, win, sum(p)::bigint as n_on, sum(1 - p)::bigint as n_off, count(*) as n from w group by stream, win")
def activity_by_polarity(spark, sf_dir):
    return windows.activity_by_polarity(windowed(spark, sf_dir))


@query(f"with {WINDOWED} select count(distinct (stream, win)) as windows, sum(p)::bigint as n_on, sum(1 - p)::bigint as n_off, count(*) as n from w")
def activity_total(spark, sf_dir):
    return windows.activity_total(windows.activity_by_polarity(windowed(spark, sf_dir)))


@query("""with o as (select stream, min(t) as t0 from fx_events group by stream)
    select e.stream, e.seq, e.t from fx_events e join o on e.stream = o.stream where e.t >= t0 + 2000000 and e.t < t0 + 7000000""")
def time_range(spark, sf_dir):
    return recordings.time_range(events(spark, sf_dir), 2_000_000, 5_000_000).select("stream", "seq", "t")


@query("select stream, count(*) as n, min(t) as t0, max(t) as t_end, round((max(t) - min(t)) / 1000000, 6) as seconds from fx_events group by stream")
def recording_span(spark, sf_dir):
    return r6(recordings.recording_span(events(spark, sf_dir)), "seconds")


@query("select stream, seq, t, least(x, 9) as x, least(y, 7) as y, p from fx_events")
def clip_coords(spark, sf_dir):
    return filters.clip_coords(events(spark, sf_dir), 10, 8).select("stream", "seq", "t", "x", "y", "p")


@query("select stream, seq, t, x, y, p from fx_events")
def packetize_roundtrip(spark, sf_dir):
    return flatten.explode_packets(flatten.packetize(events(spark, sf_dir), 1000)).select("stream", "seq", "t", "x", "y", "p")


SUPPORTED = """select e.stream, e.seq, e.t, e.x, e.y, e.p from fx_events e where exists (select 1 from fx_events f
    where f.stream = e.stream and abs(f.x - e.x) <= 1 and abs(f.y - e.y) <= 1 and (f.x <> e.x or f.y <> e.y)
      and (f.t < e.t or (f.t = e.t and f.seq < e.seq)) and e.t - f.t <= 200000)"""


@query(SUPPORTED)
def noise_filter(spark, sf_dir):
    return filters.background_activity_filter(events(spark, sf_dir), 200_000).select("stream", "seq", "t", "x", "y", "p")


SHAKEN = "s as (select stream, seq, t - (seq % 5) * 20000 as raw_t from fx_events), m as (select *, max(raw_t) over (partition by stream order by seq rows unbounded preceding) as t from s)"


def shaken(spark, sf_dir):
    return events(spark, sf_dir).withColumn("t", F.col("t") - F.col("seq") % 5 * 20_000).select("stream", "seq", "t")


@query(f"with {SHAKEN} select stream, seq, raw_t, t from m")
def monotonic_time(spark, sf_dir):
    return decode.monotonic_time(shaken(spark, sf_dir), ["seq"], BUCKETS).select("stream", "seq", "raw_t", "t")


@query(f"with {SHAKEN} select stream, sum(case when t <> raw_t then 1 else 0 end)::bigint as adjusted, count(*) as n from m group by stream")
def adjusted_count(spark, sf_dir):
    return decode.adjusted_count(decode.monotonic_time(shaken(spark, sf_dir), ["seq"], BUCKETS))


@query("select stream, t, x, y, p from fx_events")
def evt3_absolute_roundtrip(spark, sf_dir):
    packets = encoded(events(spark, sf_dir), 100_000)
    return decode.anchor_time(decode.decode(packets, "absolute"), packets, "absolute").select("stream", "t", "x", "y", "p")


@query("select stream, t // 16 as t, x, y, p from fx_events")
def evt3_packet_roundtrip(spark, sf_dir):
    packets = encoded(events(spark, sf_dir), 500_000, scale=16)
    return decode.anchor_time(decode.decode(packets, "packet"), packets, "packet").select("stream", "t", "x", "y", "p")


@query("select stream, t, x, y, p from fx_events")
def evt3_vector(spark, sf_dir):
    packets = encoded(events(spark, sf_dir), 100_000, vectors=True)
    return decode.anchor_time(decode.decode(packets, "sensor"), packets, "sensor").select("stream", "t", "x", "y", "p")


@query("select stream, 'other' as encoding, count(distinct t // 100000) as n from fx_events where stream = 1 group by stream")
def unsupported_packets(spark, sf_dir):
    packets = encoded(events(spark, sf_dir), 100_000).withColumn("encoding", F.when(F.col("stream") == 1, "other").otherwise(F.col("encoding")))
    return decode.unsupported(packets)


@query(f"""with {WINDOWED}, l as (select stream, win, max(t) as last from w group by stream, win)
    select w.stream, w.win, count(*) as n, sum(x)::bigint as sum_x, sum(last - t)::bigint as sum_age, max(x * 12 + y)::bigint as most from w join l on w.stream = l.stream and w.win = l.win group by w.stream, w.win""")
def score_windows(spark, sf_dir):
    """A model of whole numbers: the sums of x and of the ages in us, and the greatest place."""
    packed = windows.pack_windows(windows.normalize_events(windowed(spark, sf_dir), W, H, WIDTH_US))
    out = scoring.score_windows(packed, lambda m: [m[:, 0].sum() * W, (m[:, 2] * WIDTH_US).round().sum(), (m[:, 0] * W * H + m[:, 1] * H).max()])
    whole = lambda k, name: F.round(F.get("scores", F.lit(k))).cast("long").alias(name)
    return out.select("stream", "win", "n", whole(0, "sum_x"), whole(1, "sum_age"), whole(2, "most"))


CAMERAS = "select stream, concat('cam', stream) as camera, 16 as width, 12 as height, count(*) as n from fx_events group by stream"


def streams(spark, sf_dir):
    return events(spark, sf_dir).groupBy("stream").count().select("stream", F.concat(F.lit("cam"), F.col("stream")).alias("camera"), F.lit(W).alias("width"), F.lit(H).alias("height"))


def calibration(spark, sf_dir, d=(0.0,) * 5, fisheye=False, version=1):
    k = [18.0, 0.0, 7.5, 0.0, 18.5, 5.5, 0.0, 0.0, 1.0]
    return streams(spark, sf_dir).withColumns({"k": F.array(*map(F.lit, k)), "d": F.array(*map(F.lit, d)), "fisheye": F.lit(fisheye), "version_t": F.lit(version)}).drop("stream")


@query("select concat('cam', stream) as camera, x, y, x as ux, y as uy from (select distinct stream from fx_events), (select unnest(range(16))::int as x), (select unnest(range(12))::int as y)")
def remap_identity(spark, sf_dir):
    return filters.round_remap(filters.build_remap(calibration(spark, sf_dir)))


#: Three sample cameras of 640 x 480 pixels (focal lengths and centre, distortion, equidistant or not).
SAMPLES = [
    ((700.805, 702.054, 293.178, 231.417), (-0.604486, 0.443513, -0.00248195, 0.00657614, -0.330773), False),
    ((372.430, 373.203, 322.803, 230.243), (-0.415971, 0.14683, -0.0010571, -0.00426054, -0.020906), False),
    ((326.723, 327.004, 309.566, 226.712), (-0.107369, 0.0, 0.0, 0.0, 0.0), True),
]


def sample_cameras(spark, sf_dir):
    """Every stream with a sample camera."""
    kinds = F.array(*(F.struct(F.array(*map(F.lit, (k[0], 0.0, k[2], 0.0, k[1], k[3], 0.0, 0.0, 1.0))).alias("k"), F.array(*map(F.lit, d)).alias("d"), F.lit(f).alias("fisheye")) for k, d, f in SAMPLES))
    return streams(spark, sf_dir).select("camera", F.lit(640).alias("width"), F.lit(480).alias("height"), F.get(kinds, (F.col("stream") % 3).cast("int")).alias("c")).select("camera", "width", "height", "c.*")


def lens_sql(columns: dict[str, object]) -> str:
    """A value for each kind of sample camera, by stream."""
    return ", ".join(f"case stream % 3 when 0 then {v[0]!r} when 1 then {v[1]!r} else {v[2]!r} end::double as {c}" for c, v in columns.items())


INTRINSICS = {c: [k[n] for k, _, _ in SAMPLES] for n, c in enumerate(("fx", "fy", "cx", "cy"))}
COEFFICIENTS = {f"d{n}": [d[n] for _, d, _ in SAMPLES] for n in range(5)}


@query(f"""with e as (select stream, seq, (x - 7.5) / case stream % 3 when 0 then 20 else 10 end as rx, (y - 5.5) / case stream % 3 when 0 then 20 else 10 end as ry, {lens_sql(INTRINSICS)}, {lens_sql(COEFFICIENTS)} from fx_events),
    r as (select *, rx * rx + ry * ry as r2, atan(sqrt(rx * rx + ry * ry)) as a from e),
    s as (select *, 1 + d0 * r2 + d1 * r2 * r2 + d4 * r2 * r2 * r2 as radial, a * (1 + d0 * a * a + d1 * a ** 4 + d2 * a ** 6 + d3 * a ** 8) / sqrt(r2) as bent from r)
    select stream, seq, round(case when stream % 3 = 2 then rx * bent else rx * radial + 2 * d2 * rx * ry + d3 * (r2 + 2 * rx * rx) end * fx + cx, 5) as u,
      round(case when stream % 3 = 2 then ry * bent else ry * radial + d2 * (r2 + 2 * ry * ry) + 2 * d3 * rx * ry end * fy + cy, 5) as v, round(rx, 6) as rx, round(ry, 6) as ry from s""")
def lens_remap(spark, sf_dir):
    """Events as rays: where the sample cameras show them, and the rays found back from there."""
    lens = sample_cameras(spark, sf_dir).withColumn("stream", F.substring("camera", 4, 9).cast("long"))
    e = events(spark, sf_dir).join(lens, "stream")
    step = F.when(F.col("stream") % 3 == 0, 20.0).otherwise(10.0)
    x, y, d = (F.col("x") - 7.5) / step, (F.col("y") - 5.5) / step, [F.get("d", F.lit(k)) for k in range(5)]
    plain, r = filters.shown_at(x, y, d, False), F.sqrt(x * x + y * y)
    bent = filters.shown_angle(F.atan(r), d) / r
    u, v = (F.when(F.col("fisheye"), own * bent).otherwise(p) * F.element_at("k", f) + F.element_at("k", c) for own, p, f, c in ((x, plain[0], 1, 3), (y, plain[1], 5, 6)))
    found = filters.rays_at(e.select("stream", "seq", u.alias("u"), v.alias("v"), "k", "d", "fisheye"))
    return found.select("stream", "seq", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"), F.round("rx", 6).alias("rx"), F.round("ry", 6).alias("ry"))


@query(f"""with c as (select distinct stream, {lens_sql(INTRINSICS)}, {lens_sql({"d0": COEFFICIENTS["d0"]})} from fx_events),
    p as (select *, (u - cx) / fx as x0, (v - cy) / fy as y0 from c, (select unnest(range(640)) as u), (select unnest(range(480)) as v)),
    q as (select *, sqrt(x0 * x0 + y0 * y0) as r0 from p),
    r as (select stream, u, v, case when stream % 3 = 2 and r0 < pi() / 2 then x0 * tan(r0) / r0 when stream % 3 < 2 and 1.5 * r0 * sqrt(-3 * d0) < 1 then x0 / r0 * 2 / sqrt(-3 * d0) * sin(asin(1.5 * r0 * sqrt(-3 * d0)) / 3) end as rx,
      case when stream % 3 = 2 and r0 < pi() / 2 then y0 * tan(r0) / r0 when stream % 3 < 2 and 1.5 * r0 * sqrt(-3 * d0) < 1 then y0 / r0 * 2 / sqrt(-3 * d0) * sin(asin(1.5 * r0 * sqrt(-3 * d0)) / 3) end as ry from q),
    b as (select stream, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from r where rx is not null group by stream),
    n as (select stream, max(case when u = u0 then rx end) as l, min(case when u = u1 then rx end) as rr, max(case when v = v0 then ry end) as tt, min(case when v = v1 then ry end) as bb from r join b using (stream) group by stream),
    m as (select stream, u, v, round((rx - l) * 639 / (rr - l))::int as ux, round((ry - tt) * 479 / (bb - tt))::int as uy from r join n using (stream) where rx is not null)
    select e.stream, e.seq, ux as x, uy as y from fx_events e join m on e.stream = m.stream and m.u = e.x * 40 + 7 and m.v = e.y * 40 + 3 where ux between 0 and 639 and uy between 0 and 479""")
def sample_remap(spark, sf_dir):
    """Events on 640 x 480 pixels, rectified by cameras whose lenses can be inverted in closed form: one radial coefficient, or
    equidistant without any."""
    one = F.when(F.col("fisheye"), F.array(F.lit(0.0))).otherwise(F.array(F.get("d", F.lit(0))))
    remap = filters.round_remap(filters.build_remap(sample_cameras(spark, sf_dir).withColumn("d", one)))
    e = events(spark, sf_dir).select("stream", "seq", F.concat(F.lit("cam"), F.col("stream")).alias("camera"), (F.col("x") * 40 + 7).alias("x"), (F.col("y") * 40 + 3).alias("y"))
    return filters.undistort_events(e, remap).select("stream", "seq", "x", "y")


@query("select stream, seq, t, 15 - x as x, y, p from fx_events where y > 0")
def undistort_events(spark, sf_dir):
    own = events(spark, sf_dir).withColumn("camera", F.concat(F.lit("cam"), F.col("stream")))
    remap = own.select("camera", "x", "y").distinct().filter("y > 0").withColumns({"ux": F.lit(15) - F.col("x"), "uy": F.col("y")})
    return filters.undistort_events(own, remap).select("stream", "seq", "t", "x", "y", "p")


@query(f"with c as ({CAMERAS}) select stream, camera, width, height, 16 + 4 * (stream % 2)::int as calibrated_width, 12 as calibrated_height from c where stream % 2 = 1")
def resolution_mismatch(spark, sf_dir):
    s = streams(spark, sf_dir)
    other = s.select("camera", (F.col("width") + 4 * (F.col("stream") % 2)).cast("int").alias("width"), "height")
    return filters.resolution_mismatch(s, other)


@query(f"with c as ({CAMERAS}) select stream, camera, case when stream < 2 then 18.0 else 16.0 end::double as fx, case when stream < 2 then 7.5 else 8.0 end::double as cx, case when stream < 2 then 18.5 else 16.0 end::double as fy, case when stream < 2 then 5.5 else 6.0 end::double as cy from c")
def default_calibration(spark, sf_dir):
    known = calibration(spark, sf_dir).filter("camera in ('cam0', 'cam1')")
    out = filters.default_calibration(streams(spark, sf_dir), known)
    return out.select("stream", "camera", *(F.element_at("k", k).alias(n) for k, n in ((1, "fx"), (3, "cx"), (5, "fy"), (6, "cy"))))


@query(f"with c as ({CAMERAS}) select camera, width, height, case when stream % 2 = 0 and stream > 0 then 2 else 1 end as version_t, case when stream % 2 = 0 then 19.0 else 18.0 end::double as fx from c")
def upsert_calibration(spark, sf_dir):
    """New calibrations of even cameras replace the old ones: the first camera's also has the old one's version."""
    new = calibration(spark, sf_dir).filter(F.substring("camera", 4, 9).cast("int") % 2 == 0)
    new = new.withColumns({"version_t": F.when(F.col("camera") == "cam0", 1).otherwise(2), "k": F.transform("k", lambda x: x + 1)})
    out = filters.upsert_calibration(calibration(spark, sf_dir), new)
    return out.select("camera", "width", "height", "version_t", F.element_at("k", 1).alias("fx"))
