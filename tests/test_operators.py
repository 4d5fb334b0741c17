"""Properties, hand-computed cases, streaming against batch, and plans."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photonlake.functions.scan import rank, running
from photonlake.functions.search import first_at_least, path_ends
from photonlake.operators import align, decode, filters, flatten, floor, frames, inertial, late, routing, windows
from photonlake.plans import event_queries, frame_queries, live_queries, sensor_queries
from photonlake.sources import recordings
from photonlake.streaming import live
from photonlake.streaming.ordered import SHIFT_US, InOrder

EVENTS = "stream long, seq long, t long, x int, y int, p int"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


def test_scan_equals_plain_window(spark, small):
    df = event_queries.events(spark, small).select("stream", "seq", "t", F.when(F.col("seq") % 3 == 0, F.col("x")).alias("v"))
    plain = {}
    for r in df.orderBy("stream", "t", "seq").collect():
        s = plain.setdefault(r.stream, [0, None, None, {}])
        s[0] += r.v or 0
        s[1] = r.v if s[1] is None else max(s[1], r.v if r.v is not None else s[1])
        s[2] = r.v if r.v is not None else s[2]
        s[3][r.seq] = (s[0], s[1], s[2])
    for buckets in (1, 3, 50):
        for k, how in enumerate(("sum", "max", "last")):
            got = running(df, ["stream"], ["t", "seq"], how, F.col("v"), "out", buckets)
            for r in got.collect():
                assert r.out == plain[r.stream][3][r.seq][k], (how, buckets)


def test_scan_one_row_a_bucket(spark):
    df = spark.createDataFrame([(0, i, i * 10) for i in range(6)], "stream long, seq long, t long").withColumn("b", F.col("seq"))
    got = running(df, ["stream"], ["t"], "sum", F.col("seq"), "out", bucket="b").orderBy("t").collect()
    assert [r.out for r in got] == [0, 1, 3, 6, 10, 15]
    got = running(df, ["stream"], ["t"], "last", F.col("seq"), "out", bucket="b", exclusive=True).orderBy("t").collect()
    assert [r.out for r in got] == [None, 0, 1, 2, 3, 4]


@settings(deadline=None, max_examples=8)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=25), st.integers(1, 30))
def test_decimate_keeps_that_many(spark, times, most):
    df = windows.tumbling(events(spark, [(0, i, t, 0, 0, 0) for i, t in enumerate(times)]), 1000, 0)
    assert windows.decimate(df, most).count() == min(len(times), most)


def test_noise_filter_is_a_growing_subset(spark, small):
    e = event_queries.events(spark, small)
    found = [{r.seq for r in filters.background_activity_filter(e, d).collect()} for d in (100_000, 400_000)]
    assert found[0] <= found[1] <= {r.seq for r in e.collect()}


def test_own_pixel_gives_no_support(spark):
    e = events(spark, [(0, 0, 0, 5, 5, 1), (0, 1, 10, 5, 5, 1), (0, 2, 20, 6, 5, 1), (0, 3, 5000, 6, 6, 1)])
    assert [r.seq for r in filters.background_activity_filter(e, 100).collect()] == [2]


def test_decode_edges(spark):
    word = lambda k, p: (k << 12 | p).to_bytes(2, "little")
    # a vector before the first base counts from 0; the base then moves it; an 8-wide vector tests all 12 bits
    a = word(6, 7) + word(0, 3) + word(4, 0b101) + word(3, 2048 + 100) + word(5, 1 << 11) + word(4, 1)
    b = word(6, 9) + word(0, 4) + word(4, 1)  # no base: nothing
    c = word(2, 5) + word(6, 4000) + word(0, 2) + word(2, 2048 + 6) + word(6, 10) + word(2, 7)
    packets = spark.createDataFrame([(0, 0, bytearray(a)), (0, 1, bytearray(b)), (0, 2, bytearray(c))], "stream long, packet_id long, words binary")
    got = sorted((r.packet_id, r.pos, r.bit, r.t, r.x, r.y, r.p) for r in decode.decode(packets).collect())
    assert got == [(0, 2, 0, 7, 0, 3, 0), (0, 2, 2, 7, 2, 3, 0), (0, 4, 11, 7, 111, 3, 1), (0, 5, 0, 7, 108, 3, 1), (2, 3, 0, 4000, 6, 2, 1), (2, 5, 0, 4106, 7, 2, 0)]


def test_high_time_jitter_is_no_rollover(spark):
    word = lambda k, p: (k << 12 | p).to_bytes(2, "little")
    parts = [word(8, h) + word(6, 1) + word(0, 1) + word(2, 1) for h in (4090, 4085, 3)]
    packets = spark.createDataFrame([(0, i, bytearray(w)) for i, w in enumerate(parts)], "stream long, packet_id long, words binary")
    assert [r.t for r in decode.decode(packets, "sensor").orderBy("packet_id").collect()] == [4090 * 4096 + 1, 4085 * 4096 + 1, (4096 + 3) * 4096 + 1]


def test_lens_puts_rays_back():
    """The sample cameras at full size: put back within 0.01 pixel, and every ray that the model shows is found."""
    v, u = np.mgrid[0:480, 0:640].astype(float)
    rng = np.random.default_rng(1)
    for (fx, fy, cx, cy), d, fisheye in event_queries.SAMPLES:
        x0, y0 = ((u - cx) / fx).ravel(), ((v - cy) / fy).ravel()
        x, y = filters.ray_through(x0, y0, d, fisheye)
        has = ~np.isnan(x)
        assert has.mean() > 0.9
        bx, by = filters.shown_at(x[has], y[has], d, fisheye)
        assert max(np.abs(bx - x0[has]).max() * fx, np.abs(by - y0[has]).max() * fy) < 0.01
        assert (np.diff(np.where(has, x, np.nan).reshape(480, 640), axis=1) <= 0).sum() == 0
        # forwards: points whose way to the centre doesn't fold
        px, py = rng.uniform(-1.2, 1.2, (2, 4000))
        steps = np.linspace(0.01, 1, 200)[:, None]
        if fisheye:
            whole = np.ones(len(px), bool)
        else:
            xx, xy, yy = filters.slopes(px * steps, py * steps, d)
            whole = ((xx * yy - xy * xy > 1e-3) & (xx + yy > 0)).all(0)
        sx, sy = filters.shown_at(px[whole], py[whole], d, fisheye)
        qx, qy = filters.ray_through(sx, sy, d, fisheye)
        assert whole.sum() > 300 and np.abs(qx - px[whole]).max() < 1e-6 and np.abs(qy - py[whole]).max() < 1e-6


def test_remap_rounds_and_drops(spark):
    df = spark.createDataFrame([("c", 0, 0, 0.5, 1.5, 4, 4), ("c", 1, 0, -0.5, 0.0, 4, 4), ("c", 2, 0, float("nan"), 0.0, 4, 4), ("c", 3, 0, 3.6, 0.0, 4, 4), ("c", 4, 0, 1e300, 0.0, 4, 4), ("c", 5, 0, None, 0.0, 4, 4)], "camera string, x int, y int, ux double, uy double, width int, height int")
    assert [tuple(r)[1:] for r in filters.round_remap(df).collect()] == [(0, 0, 1, 2)]


def test_attitude_has_unit_norm_and_levels(spark):
    rows = [(0, i, i * 5000, 0.3, -9.8, 0.1, 0.0, 0.0, 0.0) for i in range(2000)]
    imu = spark.createDataFrame(rows, "stream long, seq long, t long, ax double, ay double, az double, wx double, wy double, wz double")
    out = inertial.attitude(imu).orderBy("t").collect()
    assert all(abs(r.qw**2 + r.qx**2 + r.qy**2 + r.qz**2 - 1) < 1e-9 for r in out)
    down = inertial.with_euler(spark.createDataFrame(out[-1:])).first()
    assert abs(math.tan(down.roll) - 0.3 / 9.8) < 1e-3


def test_nearest_tie_takes_the_older(spark):
    left = spark.createDataFrame([(0, 0, 100)], "stream long, seq long, t long")
    right = spark.createDataFrame([(0, 0, 90, 1.0), (0, 1, 110, 2.0)], "stream long, seq long, t long, v double")
    assert align.asof_nearest(left, right, "v", 50).first().v == 1.0
    assert align.asof_nearest(left, right, "v", 5, F.lit(-1.0)).first().v == -1.0


def test_gate_uses_the_upper_median_of_accepted():
    gate = floor.Gate(0.3, 10**9)
    for t, s in enumerate((1.0, 1.0, 2.0)):
        assert gate(t, (s, -0.1, 0.0))[1:] == ("fitted", False)  # fewer than three accepted: anything goes
    assert gate(3, (1.9, -0.1, 0.0))[1:] == ("held", True)  # median 1.0
    assert gate(4, (1.2, -0.1, 0.0))[1:] == ("fitted", False)
    assert gate(5, (1.5, -0.1, 0.0))[1:] == ("fitted", False)  # upper median of 1, 1, 1.2, 2 is 1.2
    assert gate(6, (1.0, 0.1, 0.0))[1:] == ("held", True)  # a positive shift
    assert gate(7, None)[1:] == ("held", False)
    assert gate(6 + 2 * 10**9, (1.0, 0.1, 0.0))[1:] == ("dropped", True)
    assert gate(7 + 2 * 10**9, None)[1:] == ("dropped", False)


def test_voters_are_spread_over_the_frame():
    got = np.flatnonzero(floor.votes_for(300_000, 7, np.arange(300_000), 4000))
    assert abs(len(got) - 4000) < 50
    assert np.bincount(got * 20 // 300_000, minlength=20).min() > 150 and np.bincount(got % 640 // 32, minlength=20).min() > 120


def test_null_streams_are_streams(spark):
    e = events(spark, [(None, 0, 5, 1, 1, 1), (None, 1, 9, 2, 1, 0), (3, 2, 7, 1, 1, 1)])
    assert windows.tumbling(e, 100).count() == 3
    for n in (1, 3):
        assert sorted(r.r for r in rank(e, ["stream"], ["t"], "r", n).collect()) == [0, 0, 1]
        assert inertial.rate_hz(e, buckets=n).count() == 3
    assert recordings.time_range(e, 0, 100).count() == 3
    assert filters.background_activity_filter(e.withColumn("extra", F.lit("kept")), 100).select("seq", "extra").collect() == [(1, "kept")]


def test_stuck_pixel_is_split_by_time(spark):
    rows = [(0, k, k * 700, 5 + k % 2, 5, 1) for k in range(2000)]
    e = events(spark, rows)
    got = sorted(r.seq for r in filters.background_activity_filter(e, 1000).collect())
    assert got == list(range(1, 2000))


def test_noise_filter_copies_few_rows(spark):
    """At 640 x 480, below 1.5 rows an event; across tile borders and cells of time the filter is as by hand."""
    rng = np.random.default_rng(5)
    xs, ys, ts = rng.integers(0, 640, 20_000), rng.integers(0, 480, 20_000), np.sort(rng.integers(0, 400_000, 20_000))
    e = events(spark, [(k % 2, k, int(t), int(x), int(y), 1) for k, (x, y, t) in enumerate(zip(xs, ys, ts, strict=True))])
    assert filters.with_halo(e).count() < 1.2 * 20_000
    last, want = {}, []
    for k, (x, y, t) in enumerate(zip(xs.tolist(), ys.tolist(), ts.tolist(), strict=True)):
        near = [last.get((k % 2, x + dx, y + dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
        if any(n is not None and t - n <= 30_000 for n in near):
            want.append(k)
        last[k % 2, x, y] = t
    filters.ROWS, rows = 3000, filters.ROWS
    try:
        assert sorted(r.seq for r in filters.background_activity_filter(e, 30_000).collect()) == want and len(want) > 200
    finally:
        filters.ROWS = rows


def test_channels_are_cut_and_filled(spark):
    rows = [(0, 0, 0, 1, 2, 3, [1, 2, 3, 4, 5, 6]), (0, 1, 1, 1, 2, 4, [1, 2, 3, 9, 4, 5, 6, 9]), (0, 2, 2, 1, 2, 1, [7, 8])]
    df = spark.createDataFrame(rows, "stream long, frame_id long, t long, height int, width int, channels int, values array<int>")
    got = {r.frame_id: r["values"] for r in frames.harmonize_shapes(df).collect()}
    assert got == {0: [1, 2, 3, 4, 5, 6], 1: [1, 2, 3, 4, 5, 6], 2: [7, 7, 7, 8, 8, 8]}


def test_floor_fit_finds_the_planted_line(spark, small):
    fits = frame_queries.floor_fit(spark, small).collect()
    assert len(fits) > 0.9 * 500
    for r in fits:
        n = r.frame_id * 4 + r.stream
        planted = (1 + n % 7 / 10) * (2 if n % 11 == 5 else 1)
        assert abs(r.slope - planted) < 0.05 and abs(r["shift"] + 0.1) < 0.05


def test_image_encodings(spark):
    values = np.array([[[1.5, -2.25, 0.0]]], "<f4")
    wide = np.array([[[1, 2, 3], [4, 5, 6]]], "<u2")
    padded = bytes([1, 2, 9, 3, 4, 9])
    rows = [
        (0, 0, 0, 1, 1, "32FC3", 12, bytearray(values.tobytes())),
        (0, 1, 0, 1, 2, "bgr16", 12, bytearray(wide.tobytes())),
        (0, 2, 0, 2, 2, "mono8", 3, bytearray(padded)),
        (0, 3, 0, 1, 1, "odd", 0, bytearray([7, 8])),
        (0, 4, 0, 1, 1, "64FC1", 8, bytearray(np.array([-0.1], "<f8").tobytes())),
    ]
    df = spark.createDataFrame(rows, "stream long, frame_id long, t long, height int, width int, encoding string, step int, data binary")
    got = {}
    for r in frames.frame_to_pixels(df).orderBy("frame_id", "v", "u", "c").collect():
        got.setdefault(r.frame_id, []).append(r.value)
    assert got == {0: [1.5, -2.25, 0.0], 1: [3, 2, 1, 6, 5, 4], 2: [1, 2, 3, 4], 3: [7, 8], 4: [-0.1]}
    with pytest.raises(ValueError):
        frames.pixels_to_frame(frames.frame_to_pixels(df), "32FC1")


def test_group_names(spark):
    df = spark.createDataFrame([("/a//b c/",), ("///",), ("x-y",)], "topic string")
    assert [r[0] for r in df.select(routing.sanitize_group(F.col("topic"))).collect()] == ["a/b_c", "topic", "x_y"]


def test_times(spark):
    r = spark.range(1).select(flatten.us_to_time(F.lit(1644507922623652)).alias("s")).first().s
    assert (r.sec, r.nanosec) == (1644507922, 623652000)


def test_dataset_prunes_groups_and_columns(spark, small, tmp_path):
    e = event_queries.events(spark, small).withColumn("group", F.concat(F.lit("g"), F.col("stream")))
    path = f"file://{tmp_path}/out"
    recordings.write_dataset(e, path)
    back = spark.read.parquet(path)
    assert back.count() == e.count()
    plan = back.filter("group = 'g1' and t > 5").select("t")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(group" in plan and "GreaterThan(t,5)" in plan and "ReadSchema: struct<t:bigint>" in plan


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Initial Plan")].count("Exchange hash") + plan[: plan.index("Initial Plan")].count("Exchange Round")


def test_frames_are_shuffled_once(spark, small):
    assert exchanges(frames.edges(frame_queries.holed(spark, small), 0.2, 1)) == 1
    assert exchanges(floor.floor_fit(frame_queries.floor_pixels(spark, small))) == 1


def test_no_window_takes_a_whole_recording(spark, small):
    plan = event_queries.noise_filter(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan and "hashpartitioning(_part" in plan


def test_streams_equal_batch(spark, small):
    """Parts that arrive in the wrong order give the rows of the batch form that the last watermark lets go."""
    key = lambda df, *c: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*c).collect())
    q = ("stream", "seq", "qw", "qx", "qy", "qz")
    whole, some = key(sensor_queries.attitude(spark, small), *q), key(live_queries.stream_attitude(spark, small), *q)
    assert set(some) <= set(whole) and len(some) > 0.4 * len(whole)
    g = ("stream", "frame_id", "state")
    whole, some = key(frame_queries.fit_gate(spark, small), *g), key(live_queries.stream_fit_gate(spark, small), *g)
    assert set(some) <= set(whole) and len(some) > 0.4 * len(whole)


class State(list):
    """What a stateful processor sees of Spark, in memory."""

    exists = lambda self: bool(self)
    get = lambda self: self[0] if self.single else iter(self)
    update = lambda self, value: self.put([value])

    def __init__(self, single):
        self.single = single

    def put(self, rows):
        self[:] = rows


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, State(False))

    def getValueState(self, name, schema):
        return self.states.setdefault(name, State(True))

    def registerTimer(self, ms):
        self.timers.add(ms)

    def listTimers(self):
        return iter(self.timers)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 60_000), st.integers(0, 9)), min_size=1, max_size=40), st.integers(1, 6), st.integers(0, 20), st.booleans())
def test_reorder_buffer_folds_in_order(arrivals, size, jitter_ms, forget):
    """Rows (time in us, how late they come) in batches of any size: the fold sees each once and in order, and forgets in the end."""
    ordered = sorted(arrivals)
    rows = [(t, k) for k, (t, _) in enumerate(ordered)]  # numbered in order of time; a number's time may lie behind by the jitter
    shaken = [(t - (k * 7919 % (jitter_ms * 1000 + 1)), k) for t, k in rows]
    come = [shaken[k] for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] + ordered[k][1] * 1000, k))]
    delay_ms = 10 + jitter_ms
    seen = []

    def fold(part, past):
        seen.extend(part["k"].tolist())
        return part, ((past[0] if past else 0) + len(part),)

    handle = Handle()
    schema = StructType().add("t", "long").add("k", "long")
    machine = InOrder(schema, "n long", fold, ["k"], "t", jitter_ms * 1000, 1000 if forget else None)
    machine.init(handle)
    mark, top = 0, 0
    for at in range(0, len(come), size):
        part = come[at : at + size]
        list(machine.handleInputRows(("key",), iter([pd.DataFrame(part, columns=["t", "k"])]), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)))
        top = max([top, *((t + SHIFT_US) // 1000 for t, _ in part)])
        mark = max(mark, top - delay_ms)
        for ms in sorted(m for m in handle.timers if m <= mark):
            handle.timers.discard(ms)
            list(machine.handleExpiredTimer(("key",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None))
    while handle.timers:
        mark = max(handle.timers) + 1
        for ms in sorted(handle.timers):
            handle.timers.discard(ms)
            list(machine.handleExpiredTimer(("key",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None))
    assert seen == list(range(len(rows))) and not handle.states["waiting"]
    assert bool(handle.states["folded"]) != forget


def test_late_packets(spark):
    p = spark.createDataFrame([(0, 0, 0, 0, 10), (0, 1, 1, 20, 30), (0, 2, 2, 5, 9), (0, 3, 3, 25, 26), (0, 4, 4, 30, 40), (0, 5, 5, None, 1)], "stream long, packet_id long, seq long, t_lo long, t_hi long")
    assert sorted((r.packet_id, r.accepted) for r in late.late_packets(p).collect()) == [(0, True), (1, True), (2, False), (3, False), (4, True), (5, False)]


def test_late_packets_in_buckets(spark):
    """Several lengths and disorders, null streams, and packets longer than buckets, against the rule itself."""
    rng = random.Random(6)
    rows, want = [], {}
    for stream, length, shake in ((0, 5, 40), (1, 90, 10), (None, 700, 300), (3, 3, 0)):
        newest = None
        for k in range(150):
            lo = max(0, k * 10 + rng.randint(-shake, shake))
            hi = lo + rng.randint(0, length)
            rows.append((stream, k, k, lo, hi))
            ok = newest is None or lo >= newest
            want[stream, k] = ok
            newest = hi if ok else newest
    p = spark.createDataFrame(rows, "stream long, packet_id long, seq long, t_lo long, t_hi long")
    for buckets in (1, 7, 40):
        assert {(r.stream, r.packet_id): r.accepted for r in late.late_packets(p, buckets).collect()} == want, buckets


def test_searches():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 100):
        a = rng.integers(0, 20, n)
        start, least = rng.integers(0, n + 1, 50), rng.integers(0, 25, 50)
        want = [next((i for i in range(s, n) if a[i] >= v), n) for s, v in zip(start, least, strict=True)]
        assert first_at_least(a, start, least).tolist() == want
        nxt = np.array([rng.integers(i + 1, n + 1) for i in range(n)])
        ends = []
        for i in range(n):
            while nxt[i] < n:
                i = nxt[i]
            ends.append(i)
        assert path_ends(nxt).tolist() == ends


def imu_rows(n, step, rng):
    return [(stream, i, i * step, *(float(c) for c in rng.normal((0.3, -9.8, 0.1), 0.5)), *(float(c) for c in rng.normal(0, 0.6, 3))) for stream in (0, None) for i in range(n)]


def test_attitude_in_parts_of_one_stream(spark):
    """Cut in time it is what it is in one piece, whether the lead is long or missing; buckets that start wrong are run again."""
    rng = np.random.default_rng(2)
    imu = spark.createDataFrame(imu_rows(1500, 5000, rng), "stream long, seq long, t long, ax double, ay double, az double, wx double, wy double, wz double")
    key = lambda df: {(r.stream, r.seq): np.array([r.qw, r.qx, r.qy, r.qz]) for r in df.collect()}
    whole = key(inertial.attitude(imu, 1))
    for buckets, lead in ((6, 2_000_000), (9, 1)):
        got = key(inertial.attitude(imu, buckets, lead))
        assert got.keys() == whole.keys() and max(np.abs(got[k] - whole[k]).max() for k in whole) < 1e-6
    report = inertial.redone_share(inertial.attitude_buckets(imu, 6, 500_000)[1]).collect()
    assert {r.buckets for r in report} <= {3, 4} and all(0 < r.redone < 1 and 1 < r.most_runs <= 4 for r in report)


def test_attitude_of_still_buckets_needs_no_second_run(spark):
    """Where the lead tells all, no bucket is run again."""
    rows = [(0, i, i * 5000, 0.0, -9.81, 0.0, 0.0, 0.0, 0.0) for i in range(900)]
    imu = spark.createDataFrame(rows, "stream long, seq long, t long, ax double, ay double, az double, wx double, wy double, wz double")
    assert inertial.redone_share(inertial.attitude_buckets(imu, 3)[1]).first().most_runs == 1


def test_gate_in_segments(spark):
    """Gaps cut a stream; in one piece and in segments the gate decides alike."""
    rng = random.Random(3)
    rows, t = [], 0
    for k in range(400):
        t += rng.choice((50_000, 50_000, 50_000, 700_000))
        fit = rng.random() < 0.8
        rows.append((k % 2, k, t, rng.choice((1.0, 1.1, 1.9)) if fit else None, rng.choice((-0.1, 0.2)) if fit else None, 0.1 if fit else None))
    fits = spark.createDataFrame(rows, "stream long, frame_id long, t long, slope double, shift double, tolerance double")
    want = {}
    for stream in (0, 1):
        gate = floor.Gate(0.3, 500_000)
        for r in rows:
            if r[0] == stream:
                want[stream, r[1]] = gate(r[2], None if r[3] is None else r[3:])[1:]
    for buckets in (1, 5):
        assert {(r.stream, r.frame_id): (r.state, r.rejected) for r in floor.fit_gate(fits, 0.3, 500_000, buckets).collect()} == want
    assert floor.gate_segments(fits, 0.3, 500_000).select("stream", "_segment").distinct().count() > 60


def test_draws_are_independent():
    """Pairs of one frame spread evenly over the square, and no two iterations share a distance."""
    for n in (3046, 5084, 150_000):
        pairs = np.array([[floor.draw(1, f, it, end, n) for end in (1, 2)] for f in range(60) for it in range(64)])
        cells = np.bincount(pairs[:, 0] * 8 // n * 8 + pairs[:, 1] * 8 // n, minlength=64)
        assert ((cells - 60) ** 2 / 60).sum() < 110  # chi-square of 63 degrees: 110 has a chance below 0.0003
        assert len({(b - a) % n for a, b in pairs[:64].tolist()}) > 60
    assert floor.draw(1, 2, 3, 1, 10**9) != floor.draw(2, 2, 3, 1, 10**9)


def test_every_hypothesis_is_usable(spark):
    w = np.random.default_rng(1).uniform(0.2, 1, 5084)
    for n in (3046, 5084):
        rows = [(s, 0, k // 640, k % 640, float(w[k]), 1.0) for s in (0, 1) for k in range(n)]
        df = spark.createDataFrame(rows, "stream long, frame_id long, v int, u int, w double, d double")
        lines = floor.hypotheses(df, 64).collect()
        assert all(sum(r.stream == s for r in lines) >= 60 for s in (0, 1))


def test_steps_of_the_fit_are_the_fit(spark, small):
    c = floor._candidates(frame_queries.floor_pixels(spark, small))
    tol = floor.tolerances(c, 0.05)
    steps = floor.refine_line(c, floor.score_hypotheses(floor.hypotheses(c, 64), c, tol), tol, 8)
    key = lambda df: sorted((r.stream, r.frame_id, round(r.slope, 9), round(r["shift"], 9), round(r.tolerance, 9), r.inliers) for r in df.collect())
    assert key(steps) == key(floor.floor_fit(frame_queries.floor_pixels(spark, small)))


def test_percentiles_of_odd_samples(spark):
    rng = random.Random(4)
    odd = [float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 1e300, -1e300, 5e-324]
    rows, by = [], {}
    for frame in range(12):
        for k in range(rng.choice((1, 2, 50))):
            v = rng.choice(odd) if rng.random() < 0.2 else rng.choice((1.5, rng.uniform(-3, 3)))
            rows.append((frame % 2 or None, frame // 2, v))
            by.setdefault((frame % 2 or None, frame // 2), []).append(v)
    df = spark.createDataFrame([*rows, (1, 0, None)], "stream long, frame_id long, d double")
    for f in (0.0, 0.02, 0.5, 0.98, 1.0):
        for r in floor.percentile_by_rank(df, f).collect():
            own = sorted(by[r.stream, r.frame_id], key=lambda v: (math.isnan(v), v))
            assert repr(r.q + 0.0) == repr(own[math.floor(f * (len(own) - 1))] + 0.0)


def test_edges_of_odd_frames(spark):
    """Gaps, several streams with one frame id, and wide edges, pixel by pixel."""
    rng = random.Random(8)
    rows = [(s, f, v * rng.choice((1, 1, 1000)), u - 3, rng.choice((1.0, 1.05, 3.0, 0.0, None))) for s in (0, None) for f in (0, 1) for v in range(9) for u in range(7)]
    rows = [(s, f, v, u, d) for (s, f, v, u), d in {r[:4]: r[4] for r in rows}.items()]
    at = {r[:4]: r[4] for r in rows}
    df = spark.createDataFrame(rows, "stream long, frame_id long, v int, u int, depth double")
    for radius in (0, 1, 2):
        edge = {}
        for s, f, v, u in at:
            near = [d for dv in (-1, 0, 1) for du in (-1, 0, 1) if (d := at.get((s, f, v + dv, u + du))) not in (None, 0.0)]
            edge[s, f, v, u] = at[s, f, v, u] not in (None, 0.0) and max(near) > 1.2 * min(near)
        span = range(-radius, radius + 1)
        want = {k: at[k] not in (None, 0.0) and any(edge.get((*k[:2], k[2] + dv, k[3] + du)) for dv in span for du in span) for k in at}
        assert {tuple(r)[:4]: r.edge for r in frames.edges(df, 0.2, radius).collect()} == want


def test_burst_is_matched_in_parts(spark):
    rng = random.Random(2)
    a = [(0, k, 1000 if k < 150 else rng.randint(900, 1100)) for k in range(300)] + [(None, k, k * 10) for k in range(50)]
    b = [(0, k, rng.randint(800, 1200)) for k in range(80)] + [(None, k, k * 17) for k in range(30)]
    left, right = (spark.createDataFrame(x, "stream long, seq long, t long") for x in (a, b))
    want = sorted((str(s), i, j) for s, i, t in a for r, j, u in b if s == r and abs(t - u) <= 40)
    for dense in (20, 10**6):
        assert sorted((str(r.stream), r.a_seq, r.b_seq) for r in align.interval_match(left, right, 40, dense).collect()) == want


def test_new_calibration_replaces_the_old(spark):
    schema = "camera string, width int, version_t long, k array<double>"
    old = spark.createDataFrame([("a", 1, 9, [1.0]), ("b", 1, 1, [1.0])], schema)
    new = spark.createDataFrame([("a", 2, 9, [2.0]), ("a", 3, 4, [3.0]), ("c", 4, None, [4.0])], schema)
    assert sorted((r.camera, r.width) for r in filters.upsert_calibration(old, new).collect()) == [("a", 2), ("b", 1), ("c", 4)]


def test_cameras_keep_their_rays(spark):
    """Two streams with one frame id, each with its camera: no pixel is doubled."""
    pixels = spark.createDataFrame([(s, 0, v, 0, 1.0) for s in (0, 1) for v in (0, 1)], "stream long, frame_id long, v int, u int, d double")
    fits = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.1), (1, 0, 2.0, 0.0, 0.1)], "stream long, frame_id long, slope double, shift double, tolerance double")
    rays = spark.createDataFrame([(0, v, 0, 0.0) for v in (0, 1)] + [(1, v, 0, 5.0 * v) for v in (0, 1)], "stream long, v int, u int, w double")
    got = sorted((r.stream, r.v, r.depth) for r in frames.metric_depth(pixels, fits, rays, 1.5).collect())
    assert got == [(0, 0, 1.5), (0, 1, 1.5), (1, 0, 3.0), (1, 1, 0.0)]
    depth = pixels.withColumnRenamed("d", "depth")
    source = spark.createDataFrame([(s, v, 0, (v + s) % 2, 0) for s in (0, 1) for v in (0, 1)], "stream long, v int, u int, sv int, su int")
    assert frames.undistort_depth(depth, source, 1, 2).count() == 4


def test_empty_tables(spark):
    e = events(spark, [])
    w = windows.tumbling(e, 1000)
    for df in (windows.window_counts(w), windows.decimate(w, 3), windows.dense_frame(w, 4, 4), filters.background_activity_filter(e), recordings.recording_span(e), flatten.packetize(e), rank(e, ["stream"], ["t"], "r")):
        assert df.collect() == []


def test_rate_in_many_buckets(spark, small):
    imu = sensor_queries.imu(spark, small)
    rates = lambda n: sorted((r.seq, r.rate_hz) for r in inertial.rate_hz(imu, buckets=n).collect())
    assert rates(1) == rates(40)


def test_waiting_rows_are_packed(monkeypatch):
    """Rows that wait take a few bytes each, and are let go a chunk at a time, in order, by whatever runs they came in."""
    from photonlake.streaming import ordered

    monkeypatch.setattr(ordered, "CHUNK", 1000)
    monkeypatch.setattr(ordered, "RUN", 4000)
    seen, sizes = [], []

    def fold(part, past):
        seen.extend(part["k"].tolist())
        sizes.append(len(part))
        return part[:0], (len(seen),)

    handle, n = Handle(), 60_000
    machine = InOrder(StructType().add("t", "long").add("k", "long"), "n long", fold, ["k"], "t", 0, None)
    machine.init(handle)
    order = np.random.default_rng(5).permutation(n // 100)
    rows = pd.DataFrame({"k": (order[:, None] * 100 + np.arange(100)).ravel()}).assign(t=lambda d: d["k"] * 10)
    parts = [rows[["t", "k"]][at : at + 700] for at in range(0, n, 700)]
    list(machine.handleInputRows(("key",), iter(parts), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    assert not seen and sum(len(c[-1]) for c in handle.states["waiting"]) < 8 * n
    mark = (SHIFT_US + 10 * (n // 2)) // 1000
    list(machine.handleExpiredTimer(("key",), SimpleNamespace(getCurrentWatermarkInMs=lambda: mark), None))
    assert seen == list(range(n // 2 + 1)) and max(sizes) <= 20_000
    list(machine.handleExpiredTimer(("key",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 2 * mark), None))
    assert seen == list(range(n)) and not handle.states["waiting"]


def test_clock_on_a_stream_equals_the_batch_form(spark):
    """Words before any high or low time or row, jitter and rollovers, in parts of any length."""
    rng = np.random.default_rng(4)
    kinds = rng.choice([8, 6, 0, 2], 400)
    words = pd.DataFrame({"stream": 0, "packet_id": np.arange(400) // 7, "pos": np.arange(400) % 7, "kind": kinds, "payload": rng.integers(0, 4096, 400)})
    want = {(r.packet_id, r.pos): (r.t, r.y) for r in decode.full_time(spark.createDataFrame(words)).collect()}
    folds = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(live, "folded_in_order", lambda rows, keys, order, fold, *rest, **more: folds.append(fold))
        live.full_times(SimpleNamespace(select=lambda *c: None))
    past, at = None, 0
    while at < len(words):
        n = int(rng.integers(1, 30))
        out, past = folds[0](words[at : at + n], past)
        for r in out.itertuples():
            t, y = want[r.packet_id, r.pos]
            assert (pd.isna(r.t) or r.t == t) and (y is None if pd.isna(r.y) else r.y == y)
            assert pd.isna(r.t) == (not (kinds[: r.packet_id * 7 + r.pos + 1] == 8).any())
        at += n


def test_nearest_on_a_stream_makes_no_pairs(spark, tmp_path):
    """Ties, borders of cells and widths, null streams and slices of any length against the rule; no join in the plan."""
    rng = random.Random(8)
    width = 40
    a = [(s, k, rng.randint(0, 60_000)) for s in (0, 1) for k in range(300)]
    b = [(s, k, rng.choice([rng.randint(0, 60_000), rng.randint(20_000, 21_000)])) for s in (0, 1) for k in range(900)]
    folds = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(live, "folded_in_order", lambda rows, keys, order, fold, *rest, **more: folds.append((rows, keys, order, fold)))
        live.nearest(*(spark.createDataFrame(r, "stream long, seq long, t long") for r in (a, b)), width)
    rows, keys, order, fold = folds[0]
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for _, part in rows.drop("_ts").toPandas().groupby(keys):
        part, past, at = part.sort_values(order, ignore_index=True), None, 0
        while at < len(part):
            n = rng.randint(1, 40)
            out, past = fold(part[at : at + n].reset_index(drop=True), past)
            got |= {(r.stream, r.a_seq): (None if pd.isna(r.b_t) else (r.b_t, r.b_seq)) for r in out.itertuples()}
            at += n
    near = lambda s, t: min(((abs(t - u), u, k) for r, k, u in b if r == s and abs(t - u) <= width), default=(0, None, None))[1:]
    assert got == {(s, k): (None if near(s, t)[0] is None else near(s, t)) for s, k, t in a}


def test_rate_of_many_samples_at_one_time(spark):
    """Windows that hold a whole stream, equal times, null times and streams against the rule; no window function looks back."""
    rng = random.Random(9)
    rows = [(s, k, None if k == 7 else rng.randint(0, 50) * 100_000) for s in (0, None) for k in range(400)]
    out = inertial.rate_hz(spark.createDataFrame(rows, "stream long, seq long, t long"))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.stream, r.seq): r.rate_hz for r in out.collect()}
    for s, k, t in rows:
        own = [] if t is None else [u for r, _, u in rows if r == s and u is not None and t - 1_000_000 <= u <= t]
        want = (len(own) - 1) / ((t - min(own)) / 1e6) if len(own) >= 2 and t > min(own) else None
        assert got[s, k] == (want if want is None else pytest.approx(want)), (s, k)
    assert len(got) == len(rows)


def test_attitude_buckets_are_read_in_pieces(spark):
    """A bucket of many batches is handed on in pieces, with the result of one piece; buckets aren't shorter than the lead."""
    rng = np.random.default_rng(3)
    schema = "stream long, seq long, t long, ax double, ay double, az double, wx double, wy double, wz double"
    imu = spark.createDataFrame(imu_rows(1500, 5000, rng), schema)
    key = lambda df: {(r.stream, r.seq): np.array([r.qw, r.qx, r.qy, r.qz]) for r in df.collect()}
    whole = key(inertial.attitude(imu, 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        got = key(inertial.attitude(imu, 6, 2_000_000))
        most = inertial.in_buckets(imu.withColumn("_bucket", F.lit(0))).mapInPandas(lambda fs: (pd.DataFrame({"n": [len(p)]}) for _, parts in inertial.pieces(fs) for p in parts), "n long").agg(F.max("n"), F.sum("n")).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tuple(most) == (70, 3000)
    assert got.keys() == whole.keys() and max(np.abs(got[k] - whole[k]).max() for k in whole) < 1e-6
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(inertial, "ATTITUDE_ROWS", 10)
        assert inertial.attitude_parts(imu, 2_000_000) == 2 * (1499 * 5000 // 2_000_000)


def test_wide_frames_are_fitted_in_parts(spark, small, monkeypatch):
    """Frames too large for a task have the fits that they have in arrays; null streams too. No group takes a whole frame."""
    pixels = frame_queries.floor_pixels(spark, small).withColumn("stream", F.when(F.col("stream") > 0, F.col("stream")))
    fits = lambda df: {(r.stream, r.frame_id, r.t): (r.slope, r.shift, r.tolerance, r.vote_share, r.inliers) for r in df.collect()}
    want = fits(floor.floor_fit(pixels, scored=20))
    monkeypatch.setattr(floor, "WIDE", 40)
    got = fits(floor.floor_fit(pixels, scored=20))
    assert got.keys() == want.keys() and len(want) > 10
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9) for k in want)
    half = pixels.filter((F.col("frame_id") % 2 == 0) | (F.col("v") < 6))  # some frames wide, some not
    assert fits(floor.floor_fit(half, scored=20)).keys() >= {k for k in want if k[1] % 2 == 0}
