"""Queries over pixels, depth and the floor fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from photonlake.operators import filters, floor, frames
from photonlake.plans.event_queries import calibration, r6
from photonlake.plans.register import query
from photonlake.sources.fixtures import view

SIDE = 8
HEIGHT = 1.5
JUMP, RADIUS = 0.2, 1
#: Of the fixtures' frames a number that differs between streams, which share frame ids.
VEC = "(frame_id * 4 + stream)"


def number():
    return F.col("frame_id") * 4 + F.col("stream")


def pixels(spark, sf_dir):
    return view(spark, sf_dir, "fx_pixels")


def grey(spark, sf_dir):
    return pixels(spark, sf_dir).select("stream", "frame_id", "t", "v", "u", F.lit(0).alias("c"), (F.floor(F.col("d") * 100) % 256).cast("double").alias("value"))


@query("select stream, frame_id, t, v, u, 0 as c, cast(floor(d * 100)::bigint % 256 as double) as value from fx_pixels")
def frame_roundtrip(spark, sf_dir):
    return frames.frame_to_pixels(frames.pixels_to_frame(grey(spark, sf_dir)))


SHAPED = """s as (select vec_id as frame_id, vec_id % 4 as stream, vec_id * 50000 as t, case when vec_id % 3 = 1 then 4 else 8 end as h, case when vec_id % 3 = 1 then 16 else 8 end as w, embedding as v from embeddings),
    f as (select stream, first(h order by t, frame_id) as th, first(w order by t, frame_id) as tw from s group by stream),
    p as (select s.*, th, tw, unnest(range(th * tw)) as i from s join f on s.stream = f.stream)"""


@query(f"""with {SHAPED} select stream, frame_id, th as height, tw as width,
    string_agg(cast(floor(v[(i // tw * (h - 1) // (th - 1)) * w + (i % tw) * (w - 1) // (tw - 1) + 1]::double * 1000) as bigint)::varchar, ',' order by i) as "values" from p group by stream, frame_id, th, tw""")
def harmonize_shapes(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    wide = F.col("vec_id") % 3 == 1
    shaped = df.select(F.col("vec_id").alias("frame_id"), (F.col("vec_id") % 4).alias("stream"), (F.col("vec_id") * 50_000).alias("t"), F.when(wide, 4).otherwise(8).alias("height"), F.when(wide, 16).otherwise(8).alias("width"), F.col("embedding").alias("values"))
    out = frames.harmonize_shapes(shaped)
    return out.select("stream", "frame_id", "height", "width", F.array_join(F.transform("values", lambda x: F.floor(x.cast("double") * 1000)), ",").alias("values"))


@query("select vec_id as frame_id, vec_id % 4 as stream from embeddings where vec_id % 5 <> 0 and vec_id % 3 <> 0 and vec_id % 4 < 3")
def frame_check(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("frame_id"), (F.col("vec_id") % 4).alias("stream"))
    df = df.withColumns({"camera": F.concat(F.lit("cam"), F.col("stream")), "encoding": F.when(F.col("frame_id") % 5 == 0, "mono8").otherwise("32FC1"), "width": F.lit(16), "height": F.lit(12), "step": F.when(F.col("frame_id") % 3 == 0, 60).otherwise(64)})
    return frames.frame_check(df, calibration(spark, sf_dir).filter("camera <> 'cam3'")).select("frame_id", "stream")


@query("select stream, frame_id, list_sort(list(round(d, 6)))[floor(0.98 * (count(*) - 1))::int + 1] as q from fx_pixels group by stream, frame_id")
def percentile_rank(spark, sf_dir):
    return r6(floor.percentile_by_rank(pixels(spark, sf_dir), 0.98), "q")


@query("""with w as (select *, min(d) over (partition by stream, frame_id) as lo, max(d) over (partition by stream, frame_id) as hi from fx_pixels)
    select stream, frame_id, v, u, cast(greatest(0, least(255, round_even((d - lo) * 255 / case when hi - lo > 1e-9 then hi - lo else 1 end, 0))) as int) as u8 from w""")
def normalize_u8(spark, sf_dir):
    return frames.normalize_u8(pixels(spark, sf_dir)).select("stream", "frame_id", "v", "u", "u8")


PLANTED = f"p as (select stream, frame_id, t, 1 + cast({VEC} % 7 as double) / 10 as slope, -0.1::double as shift, 0.05::double as tolerance from (select distinct stream, frame_id, t from fx_floor))"


def planted(spark, sf_dir):
    f = view(spark, sf_dir, "fx_floor").select("stream", "frame_id", "t").distinct()
    return f.withColumns({"slope": 1 + (number() % 7).cast("double") / 10, "shift": F.lit(-0.1), "tolerance": F.lit(0.05)})


def rays(spark, sf_dir):
    """Each stream has a camera of its own."""
    return view(spark, sf_dir, "fx_floor").select("stream", "v", "u").distinct().withColumn("w", F.when(F.col("v") >= 2 + F.col("stream") % 2, F.col("v") / 8).otherwise(0.0))


@query(f"""with {PLANTED}, x as (select f.stream, f.frame_id, f.v, f.u, f.d, slope, shift, tolerance, case when f.v >= 2 + f.stream % 2 then f.v / 8 else 0 end as w from fx_floor f join p on f.stream = p.stream and f.frame_id = p.frame_id)
    select stream, frame_id, v, u, case when d - shift > 0 and d - shift >= slope * 1.5 / 20 and not (w > 0 and d < slope * w + shift - tolerance) then round(slope * 1.5 / (d - shift), 6) else 0 end as depth from x""")
def metric_depth(spark, sf_dir):
    return r6(frames.metric_depth(view(spark, sf_dir, "fx_floor"), planted(spark, sf_dir), rays(spark, sf_dir), HEIGHT, 20.0), "depth")


def holed(spark, sf_dir):
    return pixels(spark, sf_dir).select("stream", "frame_id", "v", "u", F.when((F.col("u") + F.col("v")) % 7 == 0, 0.0).otherwise(F.col("d")).alias("depth"))


MARKED = """h as (select stream, frame_id, v, u, case when (u + v) % 7 = 0 then 0 else d end as depth from fx_pixels),
    n as (select a.stream, a.frame_id, a.v, a.u, a.depth, max(case when b.depth <> 0 then b.depth end) as hi, min(case when b.depth <> 0 then b.depth end) as lo
      from h a join h b on a.stream = b.stream and a.frame_id = b.frame_id and abs(a.v - b.v) <= 1 and abs(a.u - b.u) <= 1 group by a.stream, a.frame_id, a.v, a.u, a.depth),
    e as (select *, depth <> 0 and hi > 1.2::double * lo as e from n),
    g as (select a.stream, a.frame_id, a.v, a.u, a.depth, coalesce(bool_or(b.e), false) as near
      from e a join e b on a.stream = b.stream and a.frame_id = b.frame_id and abs(a.v - b.v) <= 1 and abs(a.u - b.u) <= 1 group by a.stream, a.frame_id, a.v, a.u, a.depth),
    m as (select *, depth <> 0 as valid, depth <> 0 and near as edge from g)"""


@query(f"with {MARKED} select stream, frame_id, v, u, round(case when edge then 0 else depth end, 6) as depth from m")
def drop_edges(spark, sf_dir):
    return r6(frames.drop_edges(holed(spark, sf_dir), JUMP, RADIUS), "depth")


@query(f"with {MARKED} select stream, frame_id, round(sum(edge::int) / greatest(sum(valid::int), 1), 6) as edge_share from m group by stream, frame_id")
def edge_share(spark, sf_dir):
    return r6(frames.edge_share(frames.edges(holed(spark, sf_dir), JUMP, RADIUS)), "edge_share")


@query("select a.stream, a.frame_id, a.v, a.u, round(coalesce(b.d, 0), 6) as depth from fx_pixels a left join fx_pixels b on a.stream = b.stream and a.frame_id = b.frame_id and a.v = b.v and b.u = a.u + 1")
def undistort_depth(spark, sf_dir):
    grid = pixels(spark, sf_dir).select("v", "u").distinct()
    source = grid.select("v", "u", F.col("v").alias("sv"), (F.col("u") + 1).cast("int").alias("su")).filter("su < 8")
    depth = pixels(spark, sf_dir).select("stream", "frame_id", "v", "u", F.col("d").alias("depth"))
    known = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr("vec_id div 4").alias("frame_id"), (F.col("vec_id") % 4).alias("stream"))
    return r6(frames.undistort_depth(depth, source, SIDE, SIDE, frames=known), "depth")


RAYS = "y as (select distinct concat('cam', stream) as camera, u::int as u, v::int as v, (u - 7.5) / 18 as rx, (v - 5.5) / 18.5 as ry from (select distinct stream from fx_events), (select unnest(range(16)) as u), (select unnest(range(12)) as v))"


@query(f"with {RAYS} select camera, round(avg(case when rx * 20 + 7.5 < -0.5 or rx * 20 + 7.5 > 15.5 or ry * 22 + 5.5 < -0.5 or ry * 22 + 5.5 > 11.5 then 1.0 else 0.0 end::double), 6) as share from y group by camera")
def rays_outside(spark, sf_dir):
    return r6(frames.rays_outside(filters.pixel_rays(calibration(spark, sf_dir)), (20.0, 22.0, 7.5, 5.5), 16, 12), "share")


@query(f"with {RAYS}, g as (select *, rx * 0.1 + ry * 0.9 + 0.2 as w from y) select camera, v, u, round(case when w / sqrt(rx * rx + ry * ry + 1) >= sin(radians(8)) then w else 0 end, 6) as w from g")
def floor_candidates(spark, sf_dir):
    own = filters.pixel_rays(calibration(spark, sf_dir)).withColumn("stream", F.substring("camera", 4, 9).cast("long"))
    gravity = own.select("stream").distinct().withColumns({"gx": F.lit(0.1), "gy": F.lit(0.9), "gz": F.lit(0.2)})
    return r6(floor.floor_candidates(own, gravity).select("camera", "v", "u", "w"), "w")


def floor_pixels(spark, sf_dir):
    return view(spark, sf_dir, "fx_floor").withColumn("w", F.when(F.col("v") >= 2, F.col("v") / 8).otherwise(0.0))


WIDE = """fx_wide as (select l_orderkey % 8 {div} 2 as frame_id, l_orderkey % 2 as stream, l_orderkey % 8 * 50000 as t, l_orderkey as v, l_linenumber * 10000000 + l_partkey * 50 + cast(l_quantity as int) as u,
      0.2 + cast(l_partkey % 997 as double) / 1000 as w,
      (1 + cast(l_orderkey % 8 as double) / 10) * (0.2 + cast(l_partkey % 997 as double) / 1000) - 0.1 + cast(l_quantity as double) / 5000 + (case when l_suppkey % 5 = 0 then 0.5 else 0 end) as d from lineitem)"""


CAND = """c as (select stream, frame_id, t, v, u, d, v / 8 as w, row_number() over (partition by stream, frame_id order by v, u) - 1 as i, count(*) over (partition by stream, frame_id) as n from fx_floor where v >= 2)"""
DRAWN = "('0x' || substr(md5(concat_ws(':', stream, frame_id, it, {end})), 1, 15))::bigint % n"
FITTED = CAND + f""",
    tol as (select stream, frame_id, 0.05 * greatest(list_sort(list(d))[floor(0.98 * (count(*) - 1))::int + 1] - list_sort(list(d))[floor(0.02 * (count(*) - 1))::int + 1], 1e-6) as tolerance from c group by stream, frame_id),
    it as (select distinct stream, frame_id, n, unnest(range(64)) as it from c),
    ab as (select stream, frame_id, it, {DRAWN.format(end=1)} as a, {DRAWN.format(end=2)} as b from it),
    ln as (select ab.stream, ab.frame_id, it, (q.d - p.d) / (q.w - p.w) as slope, p.d - (q.d - p.d) / (q.w - p.w) * p.w as intercept
      from ab join c p on ab.stream = p.stream and ab.frame_id = p.frame_id and ab.a = p.i join c q on ab.stream = q.stream and ab.frame_id = q.frame_id and ab.b = q.i where abs(q.w - p.w) >= 1e-3),
    sc as (select ln.stream, ln.frame_id, it, slope, intercept, count(*) as m, count_if(abs(slope * w + intercept - d) < tolerance) as inl, count_if(slope * w + intercept - d >= tolerance) as below
      from ln join (select * from c where (i * 2654435761 + frame_id * 40503) % 4294967296 * n < 4000 * 4294967296) c on ln.stream = c.stream and ln.frame_id = c.frame_id
      join tol on ln.stream = tol.stream and ln.frame_id = tol.frame_id group by all),
    best as (select * from (select *, inl / m as vote_share, row_number() over (partition by stream, frame_id order by inl - below desc, it) as r from sc) where r = 1 and vote_share >= 0.25),
    fit as (select c.stream, c.frame_id, c.t, regr_slope(d, w) as slope, regr_intercept(d, w) as shift, first(tolerance) as tolerance, first(vote_share) as vote_share, count(*) as inliers
      from c join best on c.stream = best.stream and c.frame_id = best.frame_id join tol on c.stream = tol.stream and c.frame_id = tol.frame_id
      where abs(best.slope * w + best.intercept - d) < tolerance group by c.stream, c.frame_id, c.t having count(*) >= 8 and regr_slope(d, w) > 0)"""


@query(f"with {FITTED} select stream, frame_id, t, round(slope, 6) as slope, round(shift, 6) as shift, round(tolerance, 6) as tolerance, round(vote_share, 6) as vote_share, inliers from fit")
def floor_fit(spark, sf_dir):
    return r6(floor.floor_fit(floor_pixels(spark, sf_dir)), "slope", "shift", "tolerance", "vote_share")


@query(f"""with {CAND}, l as (select c.*, (1 + cast({VEC} % 7 as double) / 10) * case when {VEC} % 11 = 5 then 2 else 1 end * w - 0.1 - d as r from c)
    select stream, frame_id, round(regr_slope(d, w), 6) as slope, round(regr_intercept(d, w), 6) as shift, count(*) as inliers from l where abs(r) < 0.06 group by stream, frame_id having count(*) >= 8 and regr_slope(d, w) > 0""")
def refine_line(spark, sf_dir):
    c = floor_pixels(spark, sf_dir).filter("w > 0")
    slope = (1 + (number() % 7).cast("double") / 10) * F.when(number() % 11 == 5, 2).otherwise(1)
    lines = c.select("stream", "frame_id").distinct().withColumns({"slope": slope, "intercept": F.lit(-0.1), "vote_share": F.lit(1.0)})
    out = floor.refine_line(c, lines, lines.select("stream", "frame_id", F.lit(0.06).alias("tolerance")), 8)
    return r6(out.select("stream", "frame_id", "slope", "shift", "inliers"), "slope", "shift")


def fits(spark, sf_dir):
    """A fit for every frame but each fifth; every eleventh slope is doubled."""
    p = planted(spark, sf_dir).withColumn("slope", F.col("slope") * F.when(number() % 11 == 5, 2).otherwise(1))
    return p.withColumns({c: F.when(number() % 5 != 0, F.col(c)) for c in ("slope", "shift", "tolerance")})


@query("with " + WIDE.replace("{div}", "//") + ", " + FITTED.replace("v / 8 as w,", "w,").replace("from fx_floor where v >= 2", "from fx_wide") + " select stream, frame_id, t, round(slope, 6) as slope, round(shift, 6) as shift, round(vote_share, 6) as vote_share, inliers from fit")
def floor_fit_wide(spark, sf_dir):
    """Frames of thousands of pixels (from sf0.01 on over 4000), of which a spread sample votes."""
    sql = WIDE[WIDE.index("(") + 1 : WIDE.rindex(")")].replace("{div}", "div").replace("from lineitem", "from {lineitem}")
    wide = spark.sql(sql, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet")).withColumns({c: F.col(c).cast("double") for c in ("w", "d")})
    return r6(floor.floor_fit(wide).drop("tolerance"), "slope", "shift", "vote_share")


def gated_sql(fits: str) -> str:
    """The gate as a recursion over each stream's frames; `fits`: stream, frame_id, t, slope, shift, tolerance, vote_share."""
    return f"""f as ({fits}), o as (select *, row_number() over (partition by stream order by t, frame_id) as rn from f),
    g as (select stream, 0::bigint as rn, null::bigint as frame_id, null::bigint as t, []::double[] as slopes, null::double as ls, null::double as lh, null::bigint as lt,
            null::double as slope, null::double as shift, null::varchar as state, false as rejected, null::double as vote_share from (select distinct stream from f)
      union all
      select stream, rn, frame_id, t, case when ok then list_append(hist, slope)[-10:] else hist end, case when ok then slope else ls end, case when ok then shift else lh end, case when ok then t else lt end,
            case when ok then slope when held then ls end, case when ok then shift when held then lh end, case when ok then 'fitted' when held then 'held' else 'dropped' end, slope is not null and not ok, vote_share
      from (select *, slope is not null and shift <= 0 and (len(hist) < 3 or abs(slope / list_sort(hist)[len(hist) // 2 + 1] - 1) <= 0.3) as ok
        from (select o.stream, o.rn, o.frame_id, o.t, o.slope, o.shift, o.vote_share, g.ls, g.lh, g.lt, coalesce(o.t - g.lt <= 500000, false) as held, case when coalesce(o.t - g.lt <= 500000, false) then g.slopes else []::double[] end as hist
          from g join o on o.stream = g.stream and o.rn = g.rn + 1)))"""


FITS = f"""select stream, frame_id, t, case when {VEC} % 5 <> 0 then slope * case when {VEC} % 11 = 5 then 2 else 1 end end as slope, case when {VEC} % 5 <> 0 then shift end as shift, 0 as tolerance, slope as vote_share from p"""


@query(f"with recursive {PLANTED}, {gated_sql(FITS)} select stream, frame_id, t, round(slope, 6) as slope, shift, state, rejected from g where rn > 0")
def fit_gate(spark, sf_dir):
    return r6(floor.fit_gate(fits(spark, sf_dir)).drop("tolerance"), "slope")


@query(f"""with {PLANTED}, f as (select stream, frame_id, t, case when {VEC} % 5 <> 0 then slope * case when {VEC} % 11 = 5 then 2 else 1 end end as slope from p),
    h as (select *, last_value(case when slope is not null then t end ignore nulls) over w as ft, last_value(slope ignore nulls) over w as s from f window w as (partition by stream order by t, frame_id rows unbounded preceding))
    select stream, frame_id, t, round(s, 6) as slope, t <> ft as held from h where t - ft <= 150000""")
def fit_hold(spark, sf_dir):
    return r6(floor.fit_hold(fits(spark, sf_dir), 150_000).select("stream", "frame_id", "t", "slope", "held"), "slope")


@query(f"""with recursive {PLANTED}, {gated_sql(FITS)}, s as (select *, {VEC} % 9 = 0 as low, cos({VEC} % 50 / 100) as gy, {VEC} % 10 / 10 as edge from g where rn > 0)
    select stream, t // 5000000 as report, count_if(state = 'fitted' and not low) as fitted, count_if(state = 'held' and not low) as held, count_if(state = 'dropped' and not low) as dropped, count_if(rejected and not low) as rejected, count_if(low) as low,
      round(avg(case when not low then vote_share end), 6) as mean_share, round(degrees(acos(last(gy order by t, frame_id))), 6) as tilt,
      round(coalesce(sum(case when not low and state <> 'dropped' then edge end), 0) / greatest(count_if(not low and state <> 'dropped'), 1), 6) as mean_edges from s group by 1, 2""")
def fit_report(spark, sf_dir):
    """The gate's states; every ninth frame is below the height."""
    low = number() % 9 == 0
    df = floor.fit_gate(fits(spark, sf_dir)).join(planted(spark, sf_dir).select("stream", "frame_id", F.col("slope").alias("vote_share")), ["stream", "frame_id"])
    df = df.withColumns({"state": F.when(low, "low").otherwise(F.col("state")), "rejected": F.col("rejected") & ~low, "gy": F.cos((number() % 50) / 100), "edge_share": (number() % 10) / 10})
    return r6(floor.fit_report(df), "mean_share", "tilt", "mean_edges").withColumn("mean_edges", F.coalesce("mean_edges", F.lit(0.0)))


@query(f"with {PLANTED} select stream, frame_id, t, round(slope * 1.5, 6) as scale, shift from p where {VEC} % 5 <> 0")
def fit_series(spark, sf_dir):
    return r6(floor.fit_series(fits(spark, sf_dir).withColumn("slope", F.col("slope") / F.when(number() % 11 == 5, 2).otherwise(1)), HEIGHT), "scale")


@query("select stream, seq, t, rng as height from fx_range where rng >= 1.5")
def drop_low_frames(spark, sf_dir):
    df = view(spark, sf_dir, "fx_range").withColumnRenamed("rng", "height")
    return floor.drop_low_frames(df, 1.5).select("stream", "seq", "t", "height")


@query("with g as (select seq, (qw * qw - qx * qx - qy * qy + qz * qz) / (qw * qw + qx * qx + qy * qy + qz * qz) as gy from fx_odom) select seq, round(degrees(acos(greatest(-1, least(1, gy)))), 6) as tilt from g")
def tilt(spark, sf_dir):
    from photonlake.operators.align import gravity_direction

    return r6(floor.tilt_degrees(gravity_direction(view(spark, sf_dir, "fx_odom"))).select("seq", "tilt"), "tilt")
