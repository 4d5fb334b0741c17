"""A robust line through the floor's disparities, frame by frame, and what is made of it."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions.scan import null_safe, rank, running
from photonlake.functions.shared import spread, stored
from photonlake.operators.frames import FRAME

#: The least angle at which a ray may meet the floor, scored pixels a frame, accepted fits that are kept.
MIN_ANGLE = math.radians(8)
SCORED, HISTORY, MIN_HISTORY = 4000, 10, 3
FIT_STATE = "stream long, frame_id long, t long, slope double, shift double, tolerance double, state string, rejected boolean"


def floor_candidates(rays: DataFrame, gravity: DataFrame | None = None) -> DataFrame:
    """Rays (rx, ry at depth 1) with w, their part along gravity; 0 if they meet the floor too flatly or not at all."""
    df = rays.join(gravity.select("stream", "gx", "gy", "gz"), "stream") if gravity is not None else rays.withColumns({"gx": F.lit(0.0), "gy": F.lit(1.0), "gz": F.lit(0.0)})
    w = F.col("rx") * F.col("gx") + F.col("ry") * F.col("gy") + F.col("gz")
    sees = w / F.sqrt(F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + 1) >= math.sin(MIN_ANGLE)
    return df.withColumn("w", F.when(sees, w).otherwise(0.0)).drop("gx", "gy", "gz")


#: Cells an octave of a histogram over values.
CELLS = 64


def _cell(value: Column) -> Column:
    """A number that doesn't fall where the value grows: its logarithm in steps, NaN last."""
    size = F.floor(F.signum(value) * F.log2(1 + F.abs(value) * (1 << 20)) * CELLS)
    return F.when(F.isnan(value), 1 << 40).when(value == float("inf"), 1 << 39).when(value == float("-inf"), -(1 << 39)).otherwise(size)


def percentiles_by_rank(samples: DataFrame, fractions: dict[str, float], value: str = "d") -> DataFrame:
    """For each frame the values at index floor(fraction * (n - 1)) of its sorted sample, a column each; nothing is interpolated
    and nothing sorted: a histogram, summed in each task before it is shuffled, shows the cell that holds a rank, and the values
    of those cells alone are counted one by one. So a frame, of any size, is never in one task. Nulls don't count."""
    df = samples.filter(F.col(value).isNotNull()).select(*FRAME, F.col(value).cast("double").alias("_v")).withColumn("_cell", _cell(F.col("_v")))
    up = Window.partitionBy(*FRAME).orderBy("_cell")
    hist = df.groupBy(*FRAME, "_cell").agg(F.count("*").alias("_c")).withColumns({"_upto": F.sum("_c").over(up), "_n": F.sum("_c").over(Window.partitionBy(*FRAME))})
    ranks = F.array(*(F.struct(F.lit(out).alias("out"), F.floor(f * (F.col("_n") - 1)).alias("rank")) for out, f in fractions.items()))
    held = F.filter(ranks, lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_c")))
    cells = hist.withColumn("_held", held).filter(F.size("_held") > 0).select(*FRAME, "_cell", "_held", (F.col("_upto") - F.col("_c")).alias("_before"))
    inside = null_safe(df, cells.hint("shuffle_hash"), [*FRAME, "_cell"]).groupBy(*FRAME, "_cell", "_v").agg(F.count("*").alias("_c"), F.first("_held").alias("_held"), F.first("_before").alias("_before"))
    inside = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*FRAME, "_cell").orderBy("_v")))
    at = lambda out: F.exists("_held", lambda r: (r["out"] == out) & (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_c")))
    return inside.groupBy(*FRAME).agg(*(F.max(F.when(at(out), F.col("_v"))).alias(out) for out in fractions))


def percentile_by_rank(samples: DataFrame, fraction: float, value: str = "d", out: str = "q") -> DataFrame:
    """The value at index floor(fraction * (n - 1)) of each frame's sorted sample (see `percentiles_by_rank`)."""
    return percentiles_by_rank(samples, {out: fraction}, value)


def draw(stream: int | None, frame: int, it: int, end: int, n: int) -> int:
    """A number below n from a strong hash of what it is for, so that any engine draws the same and draws don't depend on each
    other."""
    return int(hashlib.md5(f"{'' if stream is None else stream}:{frame}:{it}:{end}".encode()).hexdigest()[:15], 16) % n


def votes_for(n, frame, i, scored: int):
    """Whether pixel i of n is among about `scored`: its hash lies in the share scored / n of 32 bits."""
    return (i * 2654435761 + frame * 40503) % (1 << 32) * n < scored * (1 << 32)


def lines_through(wa: np.ndarray, da: np.ndarray, wb: np.ndarray, db: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """it, slope and intercept of lines through pairs of pixels; pairs with nearly one w give none."""
    it = np.flatnonzero(np.abs(wb - wa) >= 1e-3)
    slope = (db[it] - da[it]) / (wb[it] - wa[it])
    return it, slope, da[it] - slope * wa[it]


def best_line(it: np.ndarray, slope: np.ndarray, intercept: np.ndarray, w: np.ndarray, d: np.ndarray, tolerance: float) -> tuple[float, float, float] | None:
    """slope, intercept and share of inliers of the line with most inliers less pixels clearly below it, the first of equals."""
    if not len(it):
        return None
    r = slope[:, None] * w + intercept[:, None] - d  # lines x scored pixels at most
    inliers = np.count_nonzero(np.abs(r) < tolerance, 1)
    score = inliers - np.count_nonzero(r >= tolerance, 1)
    k = np.lexsort((it, -score))[0]
    return float(slope[k]), float(intercept[k]), float(inliers[k] / max(1, len(w)))


class Pixels(NamedTuple):
    """A frame's floor pixels in order of (v, u)."""

    stream: int | None
    frame: int
    w: np.ndarray
    d: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Pixels:
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort((column("u"), column("v")))
        return cls(table.column("stream")[0].as_py(), table.column("frame_id")[0].as_py(), column("w")[order], column("d")[order])

    def lines(self, iterations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """it, slope and intercept of lines through two drawn pixels each; pairs with nearly one w give none."""
        n = len(self.w)
        a, b = (np.array([draw(self.stream, self.frame, it, end, n) for it in range(iterations)], np.int64) for end in (1, 2))
        return lines_through(self.w[a], self.d[a], self.w[b], self.d[b])

    def best(self, it: np.ndarray, slope: np.ndarray, intercept: np.ndarray, tolerance: float, scored: int) -> tuple[float, float, float] | None:
        """The best of the lines by about `scored` voting pixels, spread over the whole frame (all, if there are no more)."""
        voting = votes_for(len(self.w), self.frame, np.arange(len(self.w), dtype=np.int64), scored)
        return best_line(it, slope, intercept, self.w[voting], self.d[voting], tolerance)

    def tolerance(self, relative: float) -> float:
        """relative * (98th - 2nd percentile by rank)."""
        ranks = [math.floor(f * (len(self.d) - 1)) for f in (0.98, 0.02)]
        hi, lo = np.partition(self.d, sorted(set(ranks)))[ranks]
        return relative * max(hi - lo, 1e-6)

    def refined(self, slope: float, intercept: float, tolerance: float) -> tuple[float, float, int] | None:
        """Least squares over all inliers."""
        near = np.abs(slope * self.w + intercept - self.d) < tolerance
        w, d = self.w[near], self.d[near]
        if len(w) < 2:
            return None
        x, y = w - w.mean(), d - d.mean()
        spread = float(x @ x)
        if not spread:
            return None
        new = float(x @ y) / spread
        return new, float(d.mean() - new * w.mean()), len(w)


def _candidates(pixels: DataFrame) -> DataFrame:
    """Floor pixels with finite disparity."""
    return pixels.filter((F.col("w") > 0) & ~F.isnan("d") & (F.abs(F.col("d")) < float("inf")))


def _values(**columns: list) -> pa.Table:
    return pa.table({k: pa.array(v, {"stream": pa.int64(), "frame_id": pa.int64(), "it": pa.int32(), "inliers": pa.int64(), "t": pa.int64()}.get(k, pa.float64())) for k, v in columns.items()})


def tolerances(candidates: DataFrame, relative: float) -> DataFrame:
    """relative * (98th - 2nd percentile by rank) of each frame."""
    df = percentiles_by_rank(candidates, {"hi": 0.98, "lo": 0.02})
    return df.select(*FRAME, (relative * F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))).alias("tolerance"))


def hypotheses(candidates: DataFrame, iterations: int) -> DataFrame:
    """stream, frame_id, it, slope, intercept of lines through two drawn pixels; pairs with nearly one w give none."""

    def make(table: pa.Table) -> pa.Table:
        p = Pixels.of(table)
        it, slope, intercept = p.lines(iterations)
        return _values(stream=[p.stream] * len(it), frame_id=[p.frame] * len(it), it=it, slope=slope, intercept=intercept)

    rows = candidates.select(*FRAME, "v", "u", F.col("w").cast("double"), F.col("d").cast("double"))
    return spread(rows, *FRAME).groupBy(*FRAME).applyInArrow(make, "stream long, frame_id long, it int, slope double, intercept double")


def score_hypotheses(lines: DataFrame, candidates: DataFrame, tolerance: DataFrame, scored: int = SCORED, min_share: float = 0.25) -> DataFrame:
    """The best line of each frame (see `Pixels.best`); none if its inliers are too few. A frame's lines meet its pixels as
    arrays, so no pair of them is a row."""

    def score(lines: pa.Table, pixels: pa.Table) -> pa.Table:
        best = None
        if lines.num_rows and pixels.num_rows:
            p = Pixels.of(pixels)
            best = p.best(*(lines.column(c).to_numpy() for c in ("it", "slope", "intercept")), lines.column("tolerance")[0].as_py(), scored)
        if best is None or best[2] < min_share:
            return _values(stream=[], frame_id=[], slope=[], intercept=[], vote_share=[])
        return _values(stream=[p.stream], frame_id=[p.frame], slope=[best[0]], intercept=[best[1]], vote_share=[best[2]])

    rows = candidates.select(*FRAME, "v", "u", F.col("w").cast("double"), F.col("d").cast("double"))
    known = null_safe(lines.select(*FRAME, "it", "slope", "intercept"), tolerance.select(*FRAME, "tolerance"), FRAME)
    return known.groupBy(*FRAME).cogroup(spread(rows, *FRAME).groupBy(*FRAME)).applyInArrow(score, "stream long, frame_id long, slope double, intercept double, vote_share double")


def refine_line(candidates: DataFrame, lines: DataFrame, tolerance: DataFrame, min_inliers: int) -> DataFrame:
    """Least squares over all inliers of each frame's line; needs enough of them and a positive slope."""
    df = null_safe(candidates, lines.select(*FRAME, F.col("slope").alias("_s"), F.col("intercept").alias("_i"), "vote_share"), FRAME)
    df = null_safe(df, tolerance.select(*FRAME, "tolerance"), FRAME)
    near = df.filter(F.abs(F.col("_s") * F.col("w") + F.col("_i") - F.col("d")) < F.col("tolerance"))
    fit = near.groupBy(*FRAME, "t").agg(F.regr_slope("d", "w").alias("slope"), F.regr_intercept("d", "w").alias("shift"), F.first("tolerance").alias("tolerance"), F.first("vote_share").alias("vote_share"), F.count("*").alias("inliers"))
    return fit.filter((F.col("inliers") >= min_inliers) & (F.col("slope") > 0))


#: Candidates of a frame that one task holds.
WIDE = 500_000


def fit_wide(candidates: DataFrame, sizes: DataFrame, iterations: int, relative: float, min_share: float, min_inliers: int, scored: int) -> DataFrame:
    """`floor_fit` of frames (`sizes`: their number of candidates, also `_n` of each) that are too large for a task: the candidates
    are ranked in parts, those that vote or are drawn go into arrays, and percentiles and least squares are aggregates."""
    tolerance = stored(tolerances(candidates, relative), "tolerances")
    label = F.concat_ws(":", F.coalesce(F.col("stream").cast("string"), F.lit("")), "frame_id", "_it", "_end")
    drawn = F.conv(F.substring(F.md5(label), 1, 15), 16, 10).cast("long") % F.col("_n")
    draws = sizes.withColumn("_it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("_end", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("_i", drawn)
    draws = draws.select(*FRAME, "_i").distinct().withColumn("_drawn", F.lit(True))
    ranked = rank(candidates.select(*FRAME, "v", "u", "w", "d", "_n"), FRAME, ["v", "u"], "_i")
    ranked = ranked.withColumn("_votes", votes_for(F.col("_n"), F.col("frame_id"), F.col("_i"), scored))
    some = null_safe(ranked, F.broadcast(draws), [*FRAME, "_i"], "left").filter("_votes or _drawn")  # a few thousand rows a frame
    some = null_safe(some, tolerance, FRAME).select(*FRAME, "_i", "_n", "_votes", "w", "d", "tolerance")

    def vote(table: pa.Table) -> pa.Table:
        i, w, d, votes = (table.column(c).to_numpy() for c in ("_i", "w", "d", "_votes"))
        stream, frame, n, tolerance = (table.column(c)[0].as_py() for c in ("stream", "frame_id", "_n", "tolerance"))
        order = np.argsort(i)
        a, b = (order[np.searchsorted(i, [draw(stream, frame, it, end, n) for it in range(iterations)], sorter=order)] for end in (1, 2))
        best = best_line(*lines_through(w[a], d[a], w[b], d[b]), w[votes], d[votes], tolerance)
        if best is None or best[2] < min_share:
            return _values(stream=[], frame_id=[], slope=[], intercept=[], vote_share=[])
        return _values(stream=[stream], frame_id=[frame], slope=[best[0]], intercept=[best[1]], vote_share=[best[2]])

    lines = some.groupBy(*FRAME).applyInArrow(vote, "stream long, frame_id long, slope double, intercept double, vote_share double")
    fit = refine_line(candidates.drop("_n"), stored(lines, "lines"), tolerance, min_inliers)
    return fit.select("stream", "frame_id", "t", "slope", "shift", "tolerance", "vote_share", "inliers")


def floor_fit(pixels: DataFrame, iterations: int = 64, relative: float = 0.05, min_share: float = 0.25, min_inliers: int = 8, scored: int = SCORED) -> DataFrame:
    """stream, frame_id, t, slope, shift, tolerance, vote_share, inliers from pixels with w and d: the steps above in one pass.
    The candidates of a frame are shuffled once, as its rows are, and everything else happens in arrays of one frame; frames of
    over WIDE candidates go the way of `fit_wide`."""

    def fit(table: pa.Table) -> pa.Table:
        p = Pixels.of(table)
        tolerance = p.tolerance(relative)
        best = p.best(*p.lines(iterations), tolerance, scored)
        found = p.refined(*best[:2], tolerance) if best is not None and best[2] >= min_share else None
        ok = found is not None and found[2] >= min_inliers and found[0] > 0
        one = lambda *x: list(x) if ok else []
        slope, shift, inliers = found or (None, None, None)
        return _values(stream=one(p.stream), frame_id=one(p.frame), t=one(table.column("t")[0].as_py()), slope=one(slope), shift=one(shift), tolerance=one(tolerance), vote_share=one(best and best[2]), inliers=one(inliers))

    rows = _candidates(pixels).select(*FRAME, "t", "v", "u", F.col("w").cast("double"), F.col("d").cast("double"))
    wide, n = None, rows.groupBy(*FRAME).agg(F.count("*").alias("_n")).filter(F.col("_n") > WIDE)
    if not n.isEmpty():
        n = stored(n, "wide")
        sized = null_safe(rows, n, FRAME, "left")
        wide, rows = fit_wide(sized.filter("_n is not null"), n, iterations, relative, min_share, min_inliers, scored), sized.filter("_n is null").drop("_n")
    small = spread(rows, *FRAME).groupBy(*FRAME).applyInArrow(fit, "stream long, frame_id long, t long, slope double, shift double, tolerance double, vote_share double, inliers long")
    return small if wide is None else small.unionByName(wide)


class Gate:
    """Which fits of a stream are accepted: a fit depends on those accepted before it, so they are seen in order."""

    def __init__(self, max_change: float, hold_us: int):
        self.max_change, self.hold_us = max_change, hold_us
        self.slopes: list[float] = []
        self.last: tuple[float, float, float] | None = None
        self.last_t: int | None = None

    def __call__(self, t: int, fit: tuple[float, float, float] | None) -> tuple[tuple[float, float, float] | None, str, bool]:
        """The fit that stands for the frame, its state, and whether the frame's own fit was rejected."""
        held = self.last_t is not None and t - self.last_t <= self.hold_us
        if not held:
            self.slopes.clear()
        rejected = fit is not None and not self.consistent(fit)
        if fit is not None and not rejected:
            self.last, self.last_t = fit, t
            self.slopes = [*self.slopes, fit[0]][-HISTORY:]
            return fit, "fitted", False
        return (self.last, "held", rejected) if held else (None, "dropped", rejected)

    def consistent(self, fit: tuple[float, float, float]) -> bool:
        if self.max_change <= 0:
            return True
        if fit[1] > 0:
            return False
        if len(self.slopes) < MIN_HISTORY:
            return True
        middle = sorted(self.slopes)[len(self.slopes) // 2]
        return abs(fit[0] / middle - 1) <= self.max_change


def gate_rows(gate: Gate, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.itertuples(index=False):
        own = None if pd.isna(r.slope) else (float(r.slope), float(r.shift), float(r.tolerance))
        fit, state, rejected = gate(int(r.t), own)
        out.append((r.stream, r.frame_id, r.t, *(fit or (None, None, None)), state, rejected))
    return pd.DataFrame(out, columns=["stream", "frame_id", "t", "slope", "shift", "tolerance", "state", "rejected"])


def gate_segments(fits: DataFrame, max_change: float, hold_us: int, buckets: int | None = None) -> DataFrame:
    """`fits` with `_segment`, which grows along a stream: a segment begins at a frame before which, for longer than the hold, no
    frame has a fit that the gate could accept. The gate remembers nothing there, so segments don't depend on each other."""
    possible = F.col("slope").isNotNull() & (F.lit(max_change <= 0) | ~F.coalesce(F.col("shift") > 0, F.lit(False)))
    df = running(fits, ["stream"], ["t", "frame_id"], "last", F.when(possible, F.col("t")), "_last", buckets, exclusive=True)
    df = df.withColumn("_begins", F.coalesce(F.col("t") - F.col("_last") > hold_us, F.lit(True)).cast("long")).drop("_last")
    return running(df, ["stream"], ["t", "frame_id"], "sum", F.col("_begins"), "_segment", buckets).drop("_begins")


def fit_gate(fits: DataFrame, max_change: float = 0.3, hold_us: int = 500_000, buckets: int | None = None) -> DataFrame:
    """Every frame's fit after the gate, and its state: fitted, held (the last accepted fit stands in) or dropped;
    `rejected` marks fits that were found and not accepted, which are held or dropped like missing ones. `fits` has one small row
    a frame, slope null where none was found. Segments of a stream (see `gate_segments`) run in parallel; one segment, in which
    each fit may depend on the one before, runs in order, and the task holds one batch of it and the gate."""
    rows = gate_segments(fits.select("stream", "frame_id", "t", "slope", "shift", "tolerance"), max_change, hold_us, buckets)
    rows = rows.repartition("stream", "_segment").sortWithinPartitions("stream", "_segment", "t", "frame_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, gate = None, None
        for f in frames:
            for key, part in f.groupby(["stream", "_segment"], sort=False, dropna=False):
                if repr(key) != own:
                    own, gate = repr(key), Gate(max_change, hold_us)
                yield gate_rows(gate, part)

    return rows.mapInPandas(run, FIT_STATE)


def fit_hold(fits: DataFrame, hold_us: int = 500_000, buckets: int | None = None) -> DataFrame:
    """Without a gate: the newest fit not older than `hold_us` stands in for a missing one; other frames go."""
    own = F.when(F.col("slope").isNotNull(), F.struct("slope", "shift", "tolerance", F.col("t").alias("ft")))
    df = running(fits, ["stream"], ["t", "frame_id"], "last", own, "_f", buckets).filter(F.col("t") - F.col("_f.ft") <= hold_us)
    return df.select("stream", "frame_id", "t", "_f.slope", "_f.shift", "_f.tolerance", (F.col("t") != F.col("_f.ft")).alias("held"))


def drop_low_frames(frames: DataFrame, min_height: float) -> DataFrame:
    return frames.filter(F.col("height") >= min_height) if min_height > 0 else frames


def fit_report(gated: DataFrame, report_us: int = 5_000_000) -> DataFrame:
    """By stream and report interval: frames fitted, held and dropped, rejected fits, frames below the height (`low`), and
    the mean vote share of all but those. With a column `gy` (of the down direction) the tilt in degrees at the interval's
    end, with `edge_share` the mean share of edges in frames that have a fit."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    own = [n("fitted"), n("held"), n("dropped"), F.count_if(F.coalesce("rejected", F.lit(False))).alias("rejected"), n("low"), F.avg(F.when(F.col("state") != "low", F.coalesce("vote_share", F.lit(0.0)))).alias("mean_share")]
    if "gy" in gated.columns:
        last = F.max_by("gy", F.when(F.col("gy").isNotNull(), F.struct("t", "frame_id")))
        own.append(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), last)))).alias("tilt"))
    if "edge_share" in gated.columns:
        own.append((F.sum(F.when(F.col("state").isin("fitted", "held"), F.col("edge_share"))) / F.greatest(F.count_if(F.col("state").isin("fitted", "held")), F.lit(1))).alias("mean_edges"))
    return gated.groupBy("stream", F.floor(F.col("t") / report_us).alias("report")).agg(*own)


def tilt_degrees(gravity: DataFrame) -> DataFrame:
    return gravity.withColumn("tilt", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("gy"))))))


def fit_series(gated: DataFrame, height: float) -> DataFrame:
    """Scale and shift of each frame that has a fit."""
    return gated.filter("slope is not null").select("stream", "frame_id", "t", (F.col("slope") * height).alias("scale"), "shift")
