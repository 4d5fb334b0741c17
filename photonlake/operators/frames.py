"""Images as rows of pixels, and depth images."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from photonlake.functions.scan import null_safe
from photonlake.functions.shared import spread

#: A frame's number counts inside its stream only.
FRAME = ["stream", "frame_id"]

#: Image encodings as (bytes a value, channels, floating).
ENCODINGS = {
    "mono8": (1, 1, False), "8UC1": (1, 1, False), "mono16": (2, 1, False), "16UC1": (2, 1, False), "rgb8": (1, 3, False),
    "bgr8": (1, 3, False), "8UC3": (1, 3, False), "rgba8": (1, 4, False), "bgra8": (1, 4, False), "8UC4": (1, 4, False),
    "rgb16": (2, 3, False), "bgr16": (2, 3, False), "rgba16": (2, 4, False), "bgra16": (2, 4, False),
    "32FC1": (4, 1, True), "32FC3": (4, 3, True), "64FC1": (8, 1, True),
}


def _float(bits: Column, exponent: int, fraction: int) -> Column:
    """An IEEE number of the given field widths from its bits as a long (64-bit ones must be below 2^63 in magnitude)."""
    e = F.shiftrightunsigned(bits, fraction).bitwiseAND((1 << exponent) - 1)
    f = bits.bitwiseAND((1 << fraction) - 1) / float(1 << fraction)
    negative = F.shiftrightunsigned(bits, exponent + fraction).bitwiseAND(1) == 1
    bias, top = (1 << (exponent - 1)) - 1, (1 << exponent) - 1
    size = F.when(e == top, F.when(f == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).when(e == 0, f * F.pow(F.lit(2.0), F.lit(1 - bias))).otherwise((1 + f) * F.pow(F.lit(2.0), e - bias))
    return F.when(negative, -size).otherwise(size)


def frame_to_pixels(frames: DataFrame, to_rgb: bool = True) -> DataFrame:
    """stream, frame_id, t, v, u, c, value (double) from little-endian image bytes.

    Unknown encodings are 8-bit, with as many channels as the size gives. `step` may pad rows; the padding goes. BGR(A)
    channels are turned to RGB(A) on request."""
    known = F.create_map(*(x for k, v in ENCODINGS.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("size"), F.lit(v[1]).alias("channels"), F.lit(v[2]).alias("floating")))))
    e = known[F.col("encoding")]
    n = F.length("data")
    guessed = F.greatest(F.lit(1), F.floor(n / (F.col("height") * F.col("width"))).cast("int"))
    df = frames.withColumns({"_size": F.coalesce(e["size"], F.lit(1)), "_ch": F.coalesce(e["channels"], guessed), "_float": F.coalesce(e["floating"], F.lit(False))})
    tight = F.col("width") * F.col("_ch") * F.col("_size")
    step = F.when((F.col("step") > 0) & (F.col("step") * F.col("height") == n), F.col("step")).otherwise(tight)
    df = df.withColumn("_step", step).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") * F.col("_ch") - 1)))
    row = F.floor(F.col("_i") / (F.col("width") * F.col("_ch"))).cast("int")
    at = row * F.col("_step") + (F.col("_i") - row * F.col("width") * F.col("_ch")) * F.col("_size")
    df = df.withColumns({"v": row, "u": F.floor((F.col("_i") - row * F.col("width") * F.col("_ch")) / F.col("_ch")).cast("int"), "_c": (F.col("_i") % F.col("_ch")).cast("int"), "_raw": F.substring("data", at.cast("int") + 1, F.col("_size"))})
    whole = F.conv(_reversed_hex(F.hex("_raw")), 16, -10).cast("long")
    value = F.when(F.col("_float") & (F.col("_size") == 4), _float(whole, 8, 23)).when(F.col("_float"), _float(whole, 11, 52)).otherwise(whole.cast("double"))
    name = F.lower("encoding")
    swapped = F.when(F.lit(to_rgb) & name.startswith("bgr") & (F.col("_ch") >= 3) & (F.col("_c") < 3), 2 - F.col("_c")).otherwise(F.col("_c"))
    return df.select("stream", "frame_id", "t", "v", "u", swapped.alias("c"), value.alias("value"))


def _reversed_hex(h: Column) -> Column:
    """Hex digits of the bytes in the other order."""
    return F.array_join(F.reverse(F.regexp_extract_all(h, F.lit("(..)"))), "")


def pixels_to_frame(pixels: DataFrame, encoding: str = "mono8") -> DataFrame:
    """8-bit pixels (v, u, c, value) as image bytes; only mono8 and bgr8 are made, values must be whole and in 0..255."""
    channels = {"mono8": 1, "bgr8": 3}.get(encoding)
    if channels is None:
        raise ValueError(f"cannot make {encoding} images")
    byte = F.lpad(F.hex(F.col("value").cast("long")), 2, "0")
    rows = F.array_sort(F.collect_list(F.struct("v", "u", "c", byte.alias("h"))))
    ok = F.bool_and(F.col("value").between(0, 255) & (F.col("value") == F.floor("value")))
    out = pixels.groupBy("stream", "frame_id", "t").agg((F.max("v") + 1).alias("height"), (F.max("u") + 1).alias("width"), F.unhex(F.array_join(F.transform(rows, lambda r: r["h"]), "")).alias("data"), ok.alias("_ok"))
    out = out.filter(F.col("_ok") & (F.length("data") == F.col("height") * F.col("width") * channels)).drop("_ok")
    return out.withColumns({"encoding": F.lit(encoding), "step": F.col("width") * channels})


def harmonize_shapes(frames: DataFrame) -> DataFrame:
    """Frames (height, width, values row by row, a pixel's channels together) resampled to the shape of their stream's first
    frame: output row i of m reads input row floor(i * (n - 1) / (m - 1)). `channels`, where there is such a column, too: extra
    ones go, and a frame with fewer repeats its first one in all."""
    many = "channels" in frames.columns
    frames = frames if many else frames.withColumn("channels", F.lit(1))
    first = frames.groupBy("stream").agg(F.min_by(F.struct("height", "width", "channels"), F.struct("t", "frame_id")).alias("_to"))
    df = null_safe(frames, first, ["stream"]).withColumns({"_h": F.col("height"), "_w": F.col("width"), "_c": F.col("channels")})  # the result's names would hide these
    source = lambda i, n, m: F.when(m > 1, F.floor(i * (n - 1) / (m - 1))).otherwise(F.lit(0))
    h, w, c = F.col("_to.height"), F.col("_to.width"), F.col("_to.channels")
    pixel = lambda i: source(F.floor(i / w), F.col("_h"), h) * F.col("_w") + source(i % w, F.col("_w"), w)
    channel = lambda i: F.when(F.col("_c") >= c, i % c).otherwise(0)
    cells = F.transform(F.sequence(F.lit(0), h * w * c - 1), lambda i: F.element_at("values", (pixel(F.floor(i / c)) * F.col("_c") + channel(i) + 1).cast("int")))
    return df.select("stream", "frame_id", "t", h.alias("height"), w.alias("width"), *([c.alias("channels")] if many else []), cells.alias("values"))


def frame_check(frames: DataFrame, calibration: DataFrame, encoding: str = "32FC1", bytes_per_value: int = 4) -> DataFrame:
    """Frames (with `camera`) of the expected encoding whose size and step are the calibration's."""
    c = calibration.select("camera", F.col("width").alias("_w"), F.col("height").alias("_h"))
    ok = (F.col("encoding") == encoding) & (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h")) & (F.col("step") == F.col("_w") * bytes_per_value)
    return frames.join(c, "camera").filter(ok).select(*frames.columns)


def normalize_u8(pixels: DataFrame, low: float = 0.0, high: float = 0.0) -> DataFrame:
    """`u8`: d scaled to 0..255 from a fixed range, or from each frame's own when high <= low; halves go to even."""
    df = pixels
    if high > low:
        lo, hi = F.lit(low), F.lit(high)
    else:
        w = Window.partitionBy(*FRAME)
        lo, hi = F.min("d").over(w), F.max("d").over(w)
    df = df.withColumns({"_lo": lo, "_hi": hi})
    span = F.when(F.col("_hi") - F.col("_lo") > 1e-9, F.col("_hi") - F.col("_lo")).otherwise(1.0)
    scaled = F.bround((F.col("d") - F.col("_lo")) * 255.0 / span, 0)
    return df.withColumn("u8", F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled)).cast("int")).drop("_lo", "_hi")


def of_camera(table: DataFrame, pixels: DataFrame) -> list[str]:
    """The columns by which a table of pixels belongs to frames: those of `camera` and `stream` that both have."""
    return [c for c in ("camera", "stream") if c in table.columns and c in pixels.columns]


def metric_depth(pixels: DataFrame, fits: DataFrame, rays: DataFrame, height: float, max_depth: float = 0.0, invalid: float = 0.0) -> DataFrame:
    """stream, frame_id, v, u, depth = slope * height / (d - shift) where that is valid, else `invalid`.

    `rays`: v, u, w (0 where a pixel can't see the floor), with `camera` or `stream` if they aren't one camera's. A pixel
    farther than the floor there isn't valid."""
    df = null_safe(pixels, fits.select(*FRAME, "slope", "shift", "tolerance"), FRAME)
    own = [*of_camera(rays, pixels), "v", "u"]
    df = null_safe(df, rays.select(*own, "w"), own)
    scale, gap, d = F.col("slope") * height, F.col("d") - F.col("shift"), F.col("d")
    least = scale / max_depth if max_depth > 0 else F.lit(0.0)
    beyond = (F.col("w") > 0) & (d < F.col("slope") * F.col("w") + F.col("shift") - F.col("tolerance"))
    ok = ~F.isnan(d) & (F.abs(d) < float("inf")) & (gap > 0) & (gap >= least) & ~beyond
    return df.select(*FRAME, "v", "u", F.when(ok, scale / gap).otherwise(invalid).alias("depth"))


def sliding(a: np.ndarray, radius: int, pick: np.ufunc, empty: float) -> np.ndarray:
    """pick over each line's last axis within `radius`, in three steps an element whatever the radius: extrema from the left and
    from the right inside blocks of a window's length (van Herk 1992)."""
    n, w = a.shape[-1], 2 * radius + 1
    wide = np.full((*a.shape[:-1], -(-(n + 2 * radius) // w) * w), empty, a.dtype)
    wide[..., radius : radius + n] = a
    blocks = wide.reshape(*a.shape[:-1], -1, w)
    ahead = pick.accumulate(blocks, -1).reshape(wide.shape)
    back = pick.accumulate(blocks[..., ::-1], -1)[..., ::-1].reshape(wide.shape)
    return pick(back[..., :n], ahead[..., w - 1 : w - 1 + n])


def square(a: np.ndarray, radius: int, pick: np.ufunc, empty: float) -> np.ndarray:
    return sliding(sliding(a, radius, pick, empty).T, radius, pick, empty).T


def close_up(frame: np.ndarray, c: np.ndarray, radius: int) -> np.ndarray:
    """Coordinates of several frames as places from 0 on, one frame behind the other; gaps between frames and those wider than any
    window are of radius + 2."""
    low, span = c.min(), int(c.max() - c.min()) + 1
    known, place = np.unique(frame * span + (c - low), return_inverse=True)
    step = np.where(np.diff(known // span) > 0, radius + 2, np.minimum(np.diff(known), radius + 2))
    return np.r_[0, np.cumsum(step)][place]


PIXELS = 1_000_000


def edges(depth: DataFrame, jump: float, radius: int, invalid: float = 0.0) -> DataFrame:
    """`valid` and `edge` of every pixel: the farthest valid depth in its 3 x 3 surroundings is over (1 + jump) times the
    nearest; edges spread by `radius` in a square. Frames are shuffled once and dealt to groups of about PIXELS, where they are
    laid into one array, one below the other; extrema slide over its rows and then over its columns. Depths that are null,
    not a number or `invalid` aren't valid."""

    def mark(table: pa.Table) -> pa.Table:
        d = table.column("depth").cast(pa.float64()).to_numpy()
        valid = ~np.isnan(d) & (d != invalid)
        stream = table.column("stream").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        frame = np.unique(table.column("frame_id").to_numpy(), return_inverse=True)[1] * (stream.max() + 1) + stream
        v, u = (table.column(c).to_numpy().astype(np.int64) for c in ("v", "u"))
        v, u = close_up(frame, v, max(1, radius)), close_up(np.zeros(len(u), np.int64), u, max(1, radius))
        shape = (v.max() + 1, u.max() + 1)
        far, near = np.full(shape, -np.inf), np.full(shape, np.inf)
        far[v[valid], u[valid]] = near[v[valid], u[valid]] = d[valid]
        jumps = np.isfinite(near) & (square(far, 1, np.maximum, -np.inf) > (1 + jump) * square(near, 1, np.minimum, np.inf))
        edge = square(jumps.astype(np.int8), radius, np.maximum, 0)[v, u].astype(bool) & valid
        return table.drop_columns("_part").append_column("valid", pa.array(valid)).append_column("edge", pa.array(edge))

    kinds = StructType(list(depth.schema.fields)).add("valid", BooleanType()).add("edge", BooleanType())
    parts = max(1, math.ceil(depth.count() / PIXELS))
    dealt = depth.withColumn("_part", F.pmod(F.xxhash64(*FRAME), F.lit(parts)).cast("int"))
    return spread(dealt, "_part").groupBy("_part").applyInArrow(mark, kinds)


def drop_edges(depth: DataFrame, jump: float, radius: int, invalid: float = 0.0) -> DataFrame:
    return edges(depth, jump, radius, invalid).withColumn("depth", F.when(F.col("edge"), F.lit(invalid)).otherwise(F.col("depth"))).drop("valid", "edge")


def edge_share(marked: DataFrame) -> DataFrame:
    return marked.groupBy(*FRAME).agg((F.count_if("edge") / F.greatest(F.count_if("valid"), F.lit(1))).alias("edge_share"))


def undistort_depth(depth: DataFrame, source: DataFrame, width: int, height: int, invalid: float = 0.0, frames: DataFrame | None = None) -> DataFrame:
    """Every output pixel reads the sensor pixel (sv, su) that `source` has for it (v, u), by `camera` or `stream` if it has such
    a column; off the sensor it is `invalid`. frames: the table of frames; without it the frames that `depth` has."""
    known = [*FRAME, *(c for c in of_camera(source, depth) if c not in FRAME)]
    pixel = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    grid = (depth.select(*known).distinct() if frames is None else frames.select(*known)).withColumn("_i", pixel)
    grid = grid.withColumns({"v": F.floor(F.col("_i") / width).cast("int"), "u": (F.col("_i") % width).cast("int")})
    own = [*of_camera(source, depth), "v", "u"]
    placed = null_safe(grid, source.select(*own, "sv", "su"), own, "left")
    read = depth.select(*FRAME, F.col("v").alias("sv"), F.col("u").alias("su"), "depth")
    return null_safe(placed, read, [*FRAME, "sv", "su"], "left").select(*FRAME, "v", "u", F.coalesce("depth", F.lit(invalid)).alias("depth"))


def rays_outside(rays: DataFrame, k: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Share of rays (rx, ry) that a pinhole (fx, fy, cx, cy) shows outside its image."""
    u, v = F.col("rx") * k[0] + k[2], F.col("ry") * k[1] + k[3]
    out = (u < -0.5) | (u > width - 0.5) | (v < -0.5) | (v > height - 0.5)
    return rays.groupBy("camera").agg(F.avg(F.when(out, 1.0).otherwise(0.0)).alias("share"))
