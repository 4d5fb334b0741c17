"""Noise filter, coordinates, calibration and lens remapping."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions.shared import spread, stored


#: A tile's side in pixels, and the length of a line of a tile with its border.
TILE = 32
STRIDE = TILE + 2
CELLS = 64
ROWS = 250_000
NEVER = np.iinfo(np.int64).min


def with_halo(events: DataFrame) -> DataFrame:
    """Events with the tile (_tx, _ty) they lie in (`_own`), and copies of those at its border for the tiles that they touch:
    about 4 of TILE events, with a tile's corner thrice. Events without a place or time go."""
    tile = lambda c, d: F.floor((F.col(c) + d) / TILE)
    near = F.array_distinct(F.array(*(F.struct(tile("x", dx).alias("x"), tile("y", dy).alias("y")) for dx in (0, -1, 1) for dy in (0, -1, 1))))
    df = events.filter("x is not null and y is not null and t is not null").withColumn("_n", F.explode(near)).withColumns({"_tx": F.col("_n.x"), "_ty": F.col("_n.y")}).drop("_n")
    return df.withColumn("_own", (F.col("_tx") == tile("x", 0)) & (F.col("_ty") == tile("y", 0)))


def last_support(pixel: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each event, in order of time, the time of the last event before it on one of its 8 neighbours, or NEVER. pixel: line *
    STRIDE + column, so that neighbours don't wrap."""
    n = len(pixel)
    rank = np.arange(n)
    key = np.sort(pixel * n + rank)
    out = np.full(n, NEVER)
    for step in (-STRIDE - 1, -STRIDE, -STRIDE + 1, -1, 1, STRIDE - 1, STRIDE, STRIDE + 1):
        near = pixel + step
        found = key[np.maximum(np.searchsorted(key, near * n + rank) - 1, 0)] if n else key
        hit = found // max(n, 1) == near
        hit &= found % max(n, 1) < rank
        out[hit] = np.maximum(out[hit], t[found[hit] % n])
    return out


def background_activity_filter(events: DataFrame, duration_us: int = 2000) -> DataFrame:
    """Events that one of their 8 neighbours supports: it fired at most `duration_us` before, in stream order.

    The published background-activity filter (Delbruck 2008): the own pixel gives no support, rejected events do. The sensor
    is cut into tiles with a border of one pixel and time into cells of CELLS durations; events at a tile's border are copied to
    the tiles they touch, and those of a cell's last duration to the next cell, so about 1.15 rows an event are shuffled. Tiles
    and cells are dealt to tasks by a hash, so one stream, and one stuck pixel, run in parallel; a task looks for each event's last
    supporter by searching sorted arrays. Columns stay; an empty table gives none."""
    span = CELLS * max(1, duration_us)
    cell = F.floor(F.col("t") / span)
    rows = with_halo(events).withColumn("_cell", F.explode(F.array_distinct(F.array(cell, F.floor((F.col("t") + duration_us) / span)))))
    rows = rows.withColumn("_own", F.col("_own") & (F.col("_cell") == cell))
    parts = max(1, math.ceil(events.count() / ROWS))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("stream", "_tx", "_ty", "_cell"), F.lit(parts)).cast("int"))
    names = events.columns

    def run(table: pa.Table) -> pa.Table:
        number = lambda c: pc.fill_null(table.column(c).cast(pa.int64()), 0).to_numpy()
        stream = table.column("stream").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        t, seq, tx, ty, cells = (number(c) for c in ("t", "seq", "_tx", "_ty", "_cell"))
        order = np.lexsort((seq, t, cells, ty, tx, stream))  # each group's events together, in stream order
        groups = np.stack([stream, tx, ty, cells])[:, order]
        group = np.cumsum(np.r_[False, (groups[:, 1:] != groups[:, :-1]).any(0)]) if len(order) else order
        lx, ly = (number("x") - tx * TILE + 1)[order], (number("y") - ty * TILE + 1)[order]
        last = last_support((group * STRIDE + ly) * STRIDE + lx, t[order])
        own = table.column("_own").to_numpy()[order]
        keep = own & (last > NEVER) & (t[order] - np.maximum(last, t[order] - duration_us - 1) <= duration_us)
        return table.take(pa.array(order[keep])).select(names)

    return spread(dealt, "_part").groupBy("_part").applyInArrow(run, events.schema)


def clip_coords(events: DataFrame, width: int, height: int) -> DataFrame:
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c)))
    return events.withColumns({"x": clamp("x", width), "y": clamp("y", height)})


def shown_at(x, y, d, fisheye):
    """Where a lens shows a normalised point, of columns or of arrays: radial-tangential (k1 k2 p1 p2 k3) or, with `fisheye`,
    equidistant (k1 k2 k3 k4)."""
    k1, k2, p1, p2, k3 = d
    if fisheye:
        r = np.maximum(np.hypot(x, y), 1e-12)
        scale = shown_angle(np.arctan(r), d) / r
        return x * scale, y * scale
    r2 = x * x + y * y
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def shown_angle(a, d):
    """The equidistant model: how far from the centre a ray at angle `a` is shown."""
    a2 = a * a
    return a * (1 + a2 * (d[0] + a2 * (d[1] + a2 * (d[2] + a2 * d[3]))))


def angle_slope(a, d):
    a2 = a * a
    return 1 + a2 * (3 * d[0] + a2 * (5 * d[1] + a2 * (7 * d[2] + a2 * 9 * d[3])))


def slopes(x, y, d):
    """Derivatives of the radial-tangential model: of x by x, of x by y (which is that of y by x), of y by y."""
    k1, k2, p1, p2, k3 = d
    r2 = x * x + y * y
    radial, bend = 1 + r2 * (k1 + r2 * (k2 + r2 * k3)), k1 + r2 * (2 * k2 + r2 * 3 * k3)
    return radial + 2 * x * x * bend + 2 * p1 * y + 6 * p2 * x, 2 * x * y * bend + 2 * p1 * x + 2 * p2 * y, radial + 2 * y * y * bend + 6 * p1 * y + 2 * p2 * x


#: A step of Newton's method behind which a point stays where it is.
STILL = 1e-14


def ray_through(x0: np.ndarray, y0: np.ndarray, d: tuple[float, ...], fisheye: bool, rounds: int = 30, most: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """The points that a lens shows at (x0, y0), NaN where it shows none there: Newton's method with bounded steps, over the
    point or (equidistant) over the angle. A result counts if the lens puts it back within `most`, and if the model doesn't
    fold between the centre and it."""
    part = np.arange(1, 17)[:, None] / 16.0
    with np.errstate(all="ignore"):
        going = np.arange(len(x0))  # points that still move
        if fisheye:
            r0 = np.hypot(x0, y0)
            a = np.minimum(r0, 1.5)
            for _ in range(rounds):
                step = np.clip((shown_angle(a[going], d) - r0[going]) / angle_slope(a[going], d), -0.2, 0.2)
                a[going] -= step
                going = going[~(np.abs(step) < STILL)]
            scale = np.where(r0 > 1e-12, np.tan(a) / np.maximum(r0, 1e-12), 1.0)
            x, y = x0 * scale, y0 * scale
            rises = (angle_slope(a * part, d) > 0).all(0) & (a >= 0) & (a < np.pi / 2)
        else:
            x, y = x0.copy(), y0.copy()
            for _ in range(rounds):
                px, py = x[going], y[going]
                sx, sy = shown_at(px, py, d, False)
                sx, sy = sx - x0[going], sy - y0[going]
                xx, xy, yy = slopes(px, py, d)
                det = xx * yy - xy * xy
                mx, my = (yy * sx - xy * sy) / det, (xx * sy - xy * sx) / det
                long = np.hypot(mx, my)
                short = np.minimum(1.0, 0.2 / np.maximum(long, 1e-300))
                x[going], y[going] = px - short * mx, py - short * my
                going = going[~(long < STILL)]
            xx, xy, yy = slopes(x * part, y * part, d)
            rises = ((xx * yy - xy * xy > 0) & (xx + yy > 0)).all(0)
        sx, sy = shown_at(x, y, d, fisheye)
        ok = rises & (np.abs(sx - x0) < most) & (np.abs(sy - y0) < most)
    return np.where(ok, x, np.nan), np.where(ok, y, np.nan)


def rays_at(points: DataFrame) -> DataFrame:
    """Image points (u, v, whole or not, with k, d and `fisheye` of their lens) with rx, ry: the point at depth 1 that the lens
    shows there; null where it shows none, beyond the turning point of its formula. Missing coefficients are 0. The
    inversion is an iteration over whole columns of points (NumPy in a Pandas UDF): as a Column expression its tree grows
    beyond what the optimizer takes."""
    d = [F.coalesce(F.get("d", F.lit(k)).cast("double"), F.lit(0.0)) for k in range(5)]
    x0, y0 = (F.col("u") - F.element_at("k", 3)) / F.element_at("k", 1), (F.col("v") - F.element_at("k", 6)) / F.element_at("k", 5)

    @F.pandas_udf("rx double, ry double")
    def rays(x: pd.Series, y: pd.Series, lens: pd.Series) -> pd.DataFrame:
        out = np.full((len(x), 2), np.nan)
        for own in lens.unique():
            at = (lens == own).to_numpy()
            *d, fisheye = map(float, own.split(","))
            out[at] = np.stack(ray_through(x.to_numpy()[at], y.to_numpy()[at], d, fisheye > 0), 1)
        return pd.DataFrame({"rx": out[:, 0], "ry": out[:, 1]})

    lens = F.concat_ws(",", *(c.cast("string") for c in (*d, F.coalesce(F.col("fisheye"), F.lit(False)).cast("int"))))
    known = lambda c: F.when(~F.isnan(f"_p.{c}"), F.col(f"_p.{c}"))
    return points.withColumn("_p", rays(x0, y0, lens)).withColumns({"rx": known("rx"), "ry": known("ry")}).drop("_p")


def pixel_rays(calibration: DataFrame, tasks: int = 64) -> DataFrame:
    """camera, v, u, rx, ry of each sensor pixel (see `rays_at`)."""
    lines = calibration.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).repartition(tasks, "camera", "v")
    grid = lines.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return rays_at(grid).select("camera", "v", "u", "rx", "ry", "k", "width", "height")


def rectified_intrinsics(rays: DataFrame) -> DataFrame:
    """Of each camera the focal lengths and centre for which the rays of its border just fill the image. The border is the
    outermost row and column on each side that have rays at all."""
    seen = rays.filter("rx is not null")
    ends = seen.groupBy("camera").agg(*(f(c).alias(f"_{n}") for n, f, c in (("left", F.min, "u"), ("right", F.max, "u"), ("top", F.min, "v"), ("bottom", F.max, "v"))))
    at = lambda f, side, c, ray: f(F.when(F.col(c) == F.col(f"_{side}"), F.col(ray)))
    agg = seen.join(ends, "camera").groupBy("camera").agg(at(F.max, "left", "u", "rx").alias("l"), at(F.min, "right", "u", "rx").alias("r"), at(F.max, "top", "v", "ry").alias("t"), at(F.min, "bottom", "v", "ry").alias("b"), F.first("width").alias("width"), F.first("height").alias("height"))
    fx, fy = (F.col("width") - 1) / (F.col("r") - F.col("l")), (F.col("height") - 1) / (F.col("b") - F.col("t"))
    return agg.select("camera", fx.alias("fx"), fy.alias("fy"), (-F.col("l") * fx).alias("cx"), (-F.col("t") * fy).alias("cy"), "width", "height")


def build_remap(calibration: DataFrame) -> DataFrame:
    """camera, x, y, ux, uy: where each sensor pixel falls in the rectified camera (not rounded; null where it has no ray). Rays
    are stored, since the border and the pixels read them."""
    rays = stored(pixel_rays(calibration), "rays")
    new = rectified_intrinsics(rays).drop("width", "height")
    return rays.join(new, "camera").select("camera", F.col("u").alias("x"), F.col("v").alias("y"), (F.col("rx") * F.col("fx") + F.col("cx")).alias("ux"), (F.col("ry") * F.col("fy") + F.col("cy")).alias("uy"), "width", "height")


def round_remap(remap: DataFrame) -> DataFrame:
    """Whole coordinates, half away from zero; what isn't a number or lies outside goes, before it is made an integer."""
    inside = lambda c, n: F.col(c).isNotNull() & ~F.isnan(c) & (F.round(c) >= 0) & (F.round(c) < F.col(n))
    kept = remap.filter(inside("ux", "width") & inside("uy", "height"))
    return kept.select("camera", "x", "y", F.round("ux").cast("int").alias("ux"), F.round("uy").cast("int").alias("uy"))


def undistort_events(events: DataFrame, remap: DataFrame) -> DataFrame:
    """Events (with `camera`) at their rectified coordinates; those without any go. The remap table has one row a sensor
    pixel; whether it is broadcast is left to its measured size."""
    out = events.join(remap, ["camera", "x", "y"]).withColumns({"x": F.col("ux"), "y": F.col("uy")})
    return out.select(*events.columns)


def resolution_mismatch(streams: DataFrame, calibration: DataFrame) -> DataFrame:
    a, b = streams.alias("a"), calibration.alias("b")
    differ = (F.col("a.width") != F.col("b.width")) | (F.col("a.height") != F.col("b.height"))
    return a.join(b, (F.col("a.camera") == F.col("b.camera")) & differ).select("a.stream", "a.camera", "a.width", "a.height", F.col("b.width").alias("calibrated_width"), F.col("b.height").alias("calibrated_height"))


def default_calibration(streams: DataFrame, calibration: DataFrame) -> DataFrame:
    """Every stream's calibration; without one, a pinhole with focal length = width and the centre in the middle."""
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    pinhole = F.array(w, F.lit(0.0), w / 2, F.lit(0.0), w, h / 2, F.lit(0.0), F.lit(0.0), F.lit(1.0))
    own = calibration.select("camera", F.col("k").alias("_k"), F.col("d").alias("_d"), F.col("fisheye").alias("_f"))
    return streams.join(own, "camera", "left").select("stream", "camera", "width", "height", F.coalesce("_k", pinhole).alias("k"), F.coalesce("_d", F.array_repeat(F.lit(0.0), 5)).alias("d"), F.coalesce("_f", F.lit(False)).alias("fisheye"))


def upsert_calibration(old: DataFrame, new: DataFrame) -> DataFrame:
    """A camera's new calibration replaces its old one whatever their versions are; of several new (or only old) ones the newest
    version counts, and of equal versions the greatest by the other columns, so that the result is always the same."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.desc(c) for c in old.columns if c not in ("camera", "version_t")]
    newest = F.row_number().over(Window.partitionBy("camera").orderBy(F.desc("_new"), F.desc_nulls_last("version_t"), *rest))
    return both.withColumn("_n", newest).filter("_n = 1").drop("_n", "_new")
