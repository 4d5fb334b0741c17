"""Inertial samples: units, bias, rotation, rates, attitude."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from photonlake.functions import quaternion
from photonlake.functions.scan import bucketed, null_safe, running, with_lead
from photonlake.functions.shared import dropped, spread, stored

#: Standard gravity used for accelerations given in g, and the filter's gains.
GRAVITY = 9.81007
KP, KI = 2.0, 0.005
#: Cells that a recording is cut into, of a window at least.
CELLS = 64
ATTITUDE = "stream long, seq long, t long, qw double, qx double, qy double, qz double"


def imu_si_units(imu: DataFrame) -> DataFrame:
    """deg/s to rad/s and g to m/s^2."""
    return imu.withColumns({c: F.col(c) * (math.pi / 180) for c in ("wx", "wy", "wz")} | {c: F.col(c) * GRAVITY for c in ("ax", "ay", "az")})


def imu_unbias(imu: DataFrame, calibrated: DataFrame, user: DataFrame | None = None) -> DataFrame:
    """Samples minus their stream's biases (columns b_ax .. b_wz); the user's values go before the calibration's."""
    axes = ("ax", "ay", "az", "wx", "wy", "wz")
    df = imu.join(calibrated.select("stream", *(F.col(f"b_{c}").alias(f"_c_{c}") for c in axes)), "stream", "left")
    if user is not None:
        df = df.join(user.select("stream", *(F.col(f"b_{c}").alias(f"_u_{c}") for c in axes)), "stream", "left")
    known = lambda c: F.coalesce(*([F.col(f"_u_{c}")] if user is not None else []), F.col(f"_c_{c}"), F.lit(0.0))
    return df.withColumns({c: F.col(c) - known(c) for c in axes}).select(*imu.columns)


def imu_rotate(imu: DataFrame, q: tuple[float, float, float, float]) -> DataFrame:
    """Both vectors in the camera's frame; q = (w, x, y, z) of unit length."""
    q = tuple(F.lit(float(c)) for c in q)
    a = quaternion.rotate(tuple(F.col(c) for c in ("ax", "ay", "az")), q)
    w = quaternion.rotate(tuple(F.col(c) for c in ("wx", "wy", "wz")), q)
    return imu.withColumns(dict(zip(("ax", "ay", "az", "wx", "wy", "wz"), (*a, *w), strict=True)))


def add_time(imu: DataFrame, add_us: int) -> DataFrame:
    return imu.withColumn("t", F.col("t") + add_us)


def stream_time_offset(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Each stream moved to the first camera's clock; streams without an offset stay."""
    return df.join(offsets.select("stream", F.col("offset_us").alias("_o")), "stream", "left").withColumn("t", F.col("t") + F.coalesce("_o", F.lit(0))).drop("_o")


def rate_hz(samples: DataFrame, window_us: int = 1_000_000, buckets: int | None = None) -> DataFrame:
    """Rate over the last second of each sample: (n - 1) / span, null for one sample or no span.

    Samples of one time are counted first, so a window has a row for each time at most. The times of a stream are cut into
    cells (`buckets` for the whole of it; as long as a window, at least), each with the window before it, where running counts
    and a search for the window's start give every rate at once, however many samples a window holds."""
    own = samples.select("stream", "seq", "t")
    times = own.filter("t is not null").groupBy("stream", "t").agg(F.count("*").alias("n"))
    low, high = own.agg(F.min("t"), F.max("t")).first()
    span = max(window_us, -(-((high or 0) - (low or 0) + 1) // (buckets or CELLS)), 1)
    cell = lambda c: F.floor(c / span)
    near = F.array_distinct(F.array(cell(F.col("t")), cell(F.col("t") + window_us)))

    def rates(table: pa.Table) -> pa.Table:
        t, n = (table.column(c).to_numpy() for c in ("t", "n"))
        order = np.argsort(t)
        t, upto = t[order], np.r_[0, np.cumsum(n[order])]
        first = np.searchsorted(t, t - window_us)
        count, long = upto[1:] - upto[first], t - t[first]
        own = t // span == table.column("_cell")[0].as_py()
        ok = (count >= 2) & (long > 0)
        rate = (count - 1) / np.where(ok, long / 1e6, 1.0)
        one = pa.array([table.column("stream")[0].as_py()], table.schema.field("stream").type)
        return pa.table({"stream": pa.chunked_array([one.take(pa.array(np.zeros(int(own.sum()), np.int64)))]), "t": t[own], "rate_hz": pa.array(rate[own], mask=~ok[own])})

    cells = times.withColumn("_cell", F.explode(near))
    found = cells.groupBy("stream", "_cell").applyInArrow(rates, StructType([own.schema["stream"], StructField("t", LongType()), StructField("rate_hz", DoubleType())]))
    return null_safe(own, found, ["stream", "t"], "left")


def valid_dt(imu: DataFrame, most_us: int = 100_000, buckets: int | None = None) -> DataFrame:
    """Seconds since the stream's sample before, and whether the step may be integrated."""
    dt = (F.col("t") - F.col("_before")) / 1e6
    df = running(imu, ["stream"], ["t", "seq"], "last", F.col("t"), "_before", buckets, exclusive=True).withColumn("dt", dt).drop("_before")
    return df.withColumn("valid", F.coalesce((F.col("dt") > 0) & (F.col("dt") < most_us / 1e6), F.lit(False)))


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def mahony_step(q: tuple, bias: tuple, gyro: tuple, accel: tuple, dt: float) -> tuple[tuple, tuple]:
    """One step of the published complementary filter on rotations (Mahony 2008). q: body to world, (w, x, y, z). Plain
    floats: three numbers are too few for arrays to pay."""
    w, x, y, z = q
    norm = math.sqrt(sum(c * c for c in accel))
    if norm > 1.0:
        expected = (2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x))
        error = cross(tuple(-c / norm for c in accel), expected)
        bias = tuple(b + KI * dt * e for b, e in zip(bias, error, strict=True))
        gyro = tuple(g + KP * e + b for g, e, b in zip(gyro, error, bias, strict=True))
    turned = cross((x, y, z), gyro)
    rate = (-(x * gyro[0] + y * gyro[1] + z * gyro[2]), *(w * g + c for g, c in zip(gyro, turned, strict=True)))
    q = tuple(c + 0.5 * dt * r for c, r in zip(q, rate, strict=True))
    size = math.sqrt(sum(c * c for c in q))
    return tuple(c / size for c in q), bias


RAW = ("ax", "ay", "az", "wx", "wy", "wz")
#: Steps whose samples are lists of Python numbers at a time.
SLICE = 50_000


def attitude_of(rows: pd.DataFrame, q: tuple, bias: tuple, last: int | None) -> tuple[pd.DataFrame, tuple, tuple, int | None]:
    """The quaternion after each row of one stream, sorted by time; steps that aren't in (0, 0.1 s) don't integrate."""
    t = rows["t"].to_numpy(np.int64)
    step = np.diff(t, prepend=t[:1] if last is None else last)
    turns = (step > 0) & (step < 100_000)
    at = np.flatnonzero(turns)
    out = np.empty((len(at) + 1, 4))
    out[0] = q
    raw = [rows[c].to_numpy(float) for c in RAW]
    for first in range(0, len(at), SLICE):
        own = at[first : first + SLICE]
        for k, (dt, ax, ay, az, wx, wy, wz) in enumerate(zip((step[own] / 1e6).tolist(), *(c[own].tolist() for c in raw), strict=True), first + 1):
            q, bias = mahony_step(q, bias, (wx, wy, wz), (ax, ay, az), dt)
            out[k] = q
    places = np.cumsum(turns)
    turned = {c: out[places, k] for k, c in enumerate(("qw", "qx", "qy", "qz"))}
    return rows[["stream", "seq", "t"]].assign(**turned), q, bias, int(t[-1]) if len(t) else last


#: Rows of a bucket, a few minutes of samples.
ATTITUDE_ROWS = 250_000
LEVEL, STILL = (1.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0)
STATE = ("qw", "qx", "qy", "qz", "bx", "by", "bz")
#: A bucket's state before its first own row, after its last one, how often it was run, and how the direction of gravity and the
#: bias at its end follow the bias at its start (6 x 3). Quaternions up to a turn about the world's y axis.
STATES = "stream long, _bucket int, runs int, " + ", ".join(f"{e}_{c} double" for e in ("s", "e") for c in ("qw", "qx", "qy", "qz", "bx", "by", "bz")) + ", s_t long, e_t long, slope array<double>"
COMPARED = STATES + ", " + ", ".join(f"p_{c} double" for c in ("qw", "qx", "qy", "qz", "bx", "by", "bz")) + ", p_t long, apart double"
NUDGE = 1e-4  # of the bias, rad/s


def _turn(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """q * conj(p), for rows of quaternions (w, x, y, z)."""
    w, x, y, z = q.T
    a, b, c, d = p.T * np.array([[1.0], [-1.0], [-1.0], [-1.0]])
    return np.stack([w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a], 1)


def _table(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])
    return out.astype({"runs": "int32", "_bucket": "int32", "stream": "Int64", **{c: "Int64" for c in ("s_t", "e_t", "p_t") if c in out}})


def _gravity(q: np.ndarray) -> np.ndarray:
    return np.array([float(c) for c in quaternion.down(*q)])


def compare(part: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """Of one stream's buckets, one row each: where each should start (p_...) by its predecessor's end, and how far that is from
    where it did, in the direction of gravity and in the bias. A predecessor that is going to be run from elsewhere itself will end
    elsewhere: its end is moved by its slope, so what the slow bias needs is handed through all buckets in one round."""
    part = part.sort_values("_bucket")
    names = [f.split()[0] for f in STATES.split(", ")]
    out, moved, before = [], np.zeros(3), None
    for row in part[names].itertuples(index=False, name=None):
        r = dict(zip(names, row, strict=True))
        sq, sb = np.array([r[f"s_{c}"] for c in ("qw", "qx", "qy", "qz")]), np.array([r[f"s_{c}"] for c in ("bx", "by", "bz")])
        if before is None:
            q, bias, t, apart = sq, sb, None, 0.0
        else:
            q, bias, t = np.array([before[f"e_{c}"] for c in ("qw", "qx", "qy", "qz")]), np.array([before[f"e_{c}"] for c in ("bx", "by", "bz")]), before["e_t"]
            if moved.any():
                change = np.array(before["slope"]).reshape(6, 3) @ moved
                old = _gravity(q)
                new = (old + change[:3]) / np.linalg.norm(old + change[:3])
                p = np.r_[1 + old @ new, np.cross(old, new)]
                q, bias = _turn(q[None], p[None] / np.linalg.norm(p))[0], bias + change[3:]
            apart = float(max(np.abs(_gravity(q) - _gravity(sq)).max(), np.abs(bias - sb).max()))
        moved = bias - sb if apart > tolerance else np.zeros(3)
        before = r
        out.append((*row, *q, *bias, t, apart))
    return _table(out, COMPARED)


def attitude_parts(imu: DataFrame, warm_us: int) -> int:
    """Buckets of about ATTITUDE_ROWS, but on average no shorter than the lead, which would else be most of the work."""
    spans = imu.groupBy("stream").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.floor((F.max("t") - F.min("t")) / warm_us)).alias("most"))
    n, most = spans.agg(F.sum("n"), F.sum("most")).first()
    return max(1, min(math.ceil((n or 0) / ATTITUDE_ROWS), most or 1))


def in_buckets(rows: DataFrame) -> DataFrame:
    """Each bucket's rows one after the other in one task, in order: read in batches (see `pieces`), a bucket may be of any size."""
    return spread(rows, "stream", "_bucket").sortWithinPartitions("stream", "_bucket", "t", "seq")


def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator[pd.DataFrame]]]:
    """The buckets of a task, each with its rows in pieces as they come. A batch with a null stream has the others as floats."""
    whole = lambda key: tuple(None if pd.isna(k) else int(k) for k in key)
    parts = ((whole(key), part) for f in frames for key, part in f.groupby(["stream", "_bucket"], sort=False, dropna=False))
    for key, own in groupby(parts, lambda p: p[0]):
        yield key, (part for _, part in own)


def attitude_buckets(imu: DataFrame, buckets: int | None = None, warm_us: int = 5_000_000, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """The samples in buckets that follow each other in time, and each bucket's states.

    A bucket starts at a level state `warm_us` before its first row. The filter forgets where it began, but for two things: a
    turn about the vertical stays (the filter moves with it, so it is put right at the end by one turn a bucket), and the bias is
    slow. So a bucket is also run with its first bias nudged along each axis, and from these slopes the buckets' biases are
    found together, as Newton's method would: a start is compared with its predecessor's end, moved by what that one's own start
    moves, and buckets whose start differs by more than `tolerance` are run again from there, until none differs. The bucket
    behind the last exact one becomes exact in each round, so it ends; the rounds needed are few and don't grow with the
    stream. `runs` says how often a bucket was run (the nudged runs aside)."""
    imu = imu.select("stream", "seq", "t", *RAW)
    rows = bucketed(imu, ["stream"], "t", buckets or attitude_parts(imu, warm_us))
    many = rows.groupBy("stream").agg(F.count_distinct("_bucket").alias("n")).agg(F.max("n")).first()[0] or 0
    warm = with_lead(rows, ["stream"], "t", warm_us) if many > 1 else rows.withColumn("_own", F.lit(True))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, parts in pieces(frames):
            q, bias, last, begun, nudged = LEVEL, STILL, None, None, []
            for part in parts:
                lead, own = part[~part["_own"]], part[part["_own"]]
                _, q, bias, last = attitude_of(lead, q, bias, last)
                if begun is None and len(own):
                    begun = (*q, *bias, last)
                    nudged = [(q, tuple(b + NUDGE * (k == j) for j, b in enumerate(bias))) for k in range(3 if many > 1 else 0)]
                nudged = [attitude_of(own, *state, last)[1:3] for state in nudged]
                _, q, bias, last = attitude_of(own, q, bias, last)
            slope = np.zeros((6, 3))
            for k, (q3, bias3) in enumerate(nudged):
                slope[:, k] = (np.r_[_gravity(q3), bias3] - np.r_[_gravity(q), bias]) / NUDGE
            yield _table([(*key, 1, *begun[:7], *q, *bias, begun[7], last, slope.ravel().tolist())], STATES)

    states = stored(in_buckets(warm).mapInPandas(first, STATES), "attitude")
    for _ in range(many - 1):
        compared = stored(states.groupBy("stream").applyInPandas(lambda part: compare(part, tolerance), COMPARED), "compared")
        late = compared.filter(F.col("apart") > tolerance)
        if late.isEmpty():
            dropped(compared)
            break

        def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for key, parts in pieces(frames):
                begun = None
                for part in parts:
                    if begun is None:
                        begun = tuple(float(part[f"p_{c}"].iloc[0]) for c in STATE)
                        start = last = int(part["p_t"].iloc[0])
                        runs, q, bias = int(part["runs"].iloc[0]), begun[:4], begun[4:]
                    _, q, bias, last = attitude_of(part, q, bias, last)
                yield _table([(*key, runs + 1, *begun, *q, *bias, start, last, [])], STATES)

        own = null_safe(rows, late.select("stream", "_bucket", "runs", *(f"p_{c}" for c in STATE), "p_t"), ["stream", "_bucket"])
        redone = null_safe(in_buckets(own).mapInPandas(again, STATES).drop("slope"), late.select("stream", "_bucket", "slope"), ["stream", "_bucket"])
        old, states = states, stored(redone.unionByName(compared.filter(F.col("apart") <= tolerance).select(*states.columns)), "attitude")
        dropped(old)
        dropped(compared)
    return rows, states


def attitude(imu: DataFrame, buckets: int | None = None, warm_us: int = 5_000_000, tolerance: float = 1e-9) -> DataFrame:
    """Attitude after each sample (SI units), one long stream in many tasks (see `attitude_buckets`). The turns about the vertical
    that part neighbouring buckets are summed over one row a bucket."""
    rows, states = attitude_buckets(imu, buckets, warm_us, tolerance)

    def begin(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_bucket")
        s, e = (part[[f"{k}_{c}" for c in ("qw", "qx", "qy", "qz")]].to_numpy() for k in ("s", "e"))
        turn = _turn(e[:-1], s[1:])
        angle = np.r_[0.0, np.cumsum(np.arctan2(turn[:, 2], turn[:, 0]))]
        w, y = np.cos(angle), np.sin(angle)
        q = np.stack([w * s[:, 0] - y * s[:, 2], w * s[:, 1] + y * s[:, 3], w * s[:, 2] + y * s[:, 0], w * s[:, 3] - y * s[:, 1]], 1)
        return part[["stream", "_bucket", "s_bx", "s_by", "s_bz", "s_t"]].assign(**dict(zip(("qw", "qx", "qy", "qz"), q.T, strict=True)))

    starts = states.groupBy("stream").applyInPandas(begin, "stream long, _bucket int, s_bx double, s_by double, s_bz double, s_t long, qw double, qx double, qy double, qz double")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, parts in pieces(frames):
            q = None
            for part in parts:
                if q is None:
                    s = part.iloc[0]
                    last = None if pd.isna(s["s_t"]) else int(s["s_t"])
                    q, bias = tuple(float(s[c]) for c in STATE[:4]), tuple(float(s[f"s_{c}"]) for c in STATE[4:])
                out, q, bias, last = attitude_of(part, q, bias, last)
                yield out

    return in_buckets(null_safe(rows, starts, ["stream", "_bucket"])).mapInPandas(run, ATTITUDE)


def redone_share(states: DataFrame) -> DataFrame:
    """Of each stream its buckets, and the share of those that were run more than once."""
    return states.groupBy("stream").agg(F.count("*").alias("buckets"), F.avg((F.col("runs") > 1).cast("double")).alias("redone"), F.max("runs").alias("most_runs"))


def with_euler(df: DataFrame) -> DataFrame:
    angles = quaternion.euler(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    return df.withColumns(dict(zip(("roll", "pitch", "yaw"), angles, strict=True)))


def latest_per_stream(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def elapsed_seconds(df: DataFrame) -> DataFrame:
    first = df.groupBy("stream").agg(F.min("t").alias("_t0"))
    return df.join(first, "stream").withColumn("elapsed", (F.col("t") - F.col("_t0")) / 1e6).drop("_t0")
