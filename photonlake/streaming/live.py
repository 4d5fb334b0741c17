"""Structured Streaming counterparts of the batch operators.

Recursions wait for the watermark and see their rows in order (`ordered`), so what arrives late or shuffled gives the batch
result. A source folder and a checkpoint folder are all a query needs to go on after a failure.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photonlake.functions.shared import new_folder
from photonlake.operators import filters, floor, inertial
from photonlake.streaming.ordered import folded_in_order, keep_state_on_disk, marked


def scan(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    """An unbounded scan of a folder that fills with Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs an append-mode stream over what there is now, into Parquet, and reads the result."""
    spark = stream.sparkSession
    keep_state_on_disk(spark)
    out = new_folder(spark, name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_folder(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def record(stream: DataFrame, topics: list[str], path: str, checkpoint: str):
    """Starts recording an allow-list of topics, one folder a topic."""
    return stream.filter(F.col("topic").isin(topics)).writeStream.format("parquet").partitionBy("topic").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_ts(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", delay)


def tumbling_counts(events: DataFrame, width_us: int, delay: str = "0 seconds") -> DataFrame:
    """stream, win, y, x, n_on, n_off of windows that are complete: their end is behind the watermark."""
    w = F.window("ts", f"{width_us} microseconds")
    out = with_ts(events, delay).groupBy(w, "stream", "y", "x").agg(F.count_if(F.col("p") == 1).alias("n_on"), F.count_if(F.col("p") == 0).alias("n_off"))
    return out.select("stream", F.floor(F.unix_micros("window.start") / width_us).alias("win"), "y", "x", "n_on", "n_off")


def sliding_rate(samples: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Rate over the last second, every 0.1 s."""
    out = with_ts(samples, delay).groupBy(F.window("ts", "1 second", "100 milliseconds"), "stream").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return out.select("stream", F.unix_micros("window.end").alias("t_end"), F.when((F.col("n") >= 2) & (F.col("b") > F.col("a")), (F.col("n") - 1) / ((F.col("b") - F.col("a")) / 1e6)).alias("rate_hz"))


def on_time(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Rows that aren't late: those behind the watermark of the batches before go, row by row."""
    return with_ts(events, delay).dropDuplicatesWithinWatermark(["stream", "seq"]).drop("ts")


def late_packets(packets: DataFrame, delay: str = "1 second", jitter_us: int = 0) -> DataFrame:
    """stream, packet_id and whether a packet (t_lo to t_hi, in order of arrival `seq`) is accepted: no accepted one before it is
    newer than its first event. The newest accepted time of each stream is the state. jitter_us: how far a packet's first event
    may lie behind that of one that arrived before it."""

    def fold(rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        newest, keep = past[0] if past else None, []
        for lo, hi in zip(rows["t_lo"].tolist(), rows["t_hi"].tolist(), strict=True):
            keep.append(newest is None or lo >= newest)
            newest = int(hi) if keep[-1] else newest
        return rows[["stream", "packet_id"]].assign(accepted=keep), (newest,)

    rows = packets.select("stream", "packet_id", "seq", "t_lo", "t_hi")
    return folded_in_order(rows, ["stream"], ["seq"], fold, "newest long", "stream long, packet_id long, accepted boolean", delay, "t_lo", jitter_us)


def noise_filter(events: DataFrame, duration_us: int, delay: str = "1 second") -> DataFrame:
    """The background-activity filter, event by event in stream order whatever order they arrive in. Keys are tiles of the
    sensor with a border of one pixel; a tile's state is the last time of each of its pixels that can still give support, and
    goes once the watermark has passed that."""
    columns = ["stream", "x", "y", "t", "seq", "p"]
    tiles = filters.with_halo(events.select(*columns)).withColumnsRenamed({"_tx": "tx", "_ty": "ty", "_own": "own"})
    state = "pixels array<long>, times array<long>"

    def fold(rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        pixels, times = (np.array(c, np.int64) for c in (past or ((), ())))
        lx, ly = rows["x"].to_numpy(np.int64) - rows["tx"].to_numpy(np.int64) * filters.TILE + 1, rows["y"].to_numpy(np.int64) - rows["ty"].to_numpy(np.int64) * filters.TILE + 1
        pixel, t = np.r_[pixels, ly * filters.STRIDE + lx], np.r_[times, rows["t"].to_numpy(np.int64)]
        last = filters.last_support(pixel, t)[len(times) :]
        own, now = rows["own"].to_numpy(bool), rows["t"].to_numpy(np.int64)
        keep = own & (last > filters.NEVER) & (now - np.maximum(last, now - duration_us - 1) <= duration_us)
        newest = dict(zip(pixel.tolist(), t.tolist(), strict=True))  # later rows win
        left = sorted((at, where) for where, at in newest.items() if at >= int(t[-1]) - duration_us)
        return rows[keep][columns].astype({"p": "Int32"}), ([w for _, w in left], [at for at, _ in left])

    return folded_in_order(tiles, ["stream", "tx", "ty"], ["t", "seq"], fold, state, "stream long, x int, y int, t long, seq long, p int", delay, forget_us=duration_us)


def attitude(imu: DataFrame, delay: str = "1 second") -> DataFrame:
    """The attitude filter with quaternion, bias and last time as state of each stream; samples integrate in order of time."""

    def fold(rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        q, bias, last = (tuple(past[:4]), tuple(past[4:7]), past[7]) if past else (inertial.LEVEL, inertial.STILL, None)
        out, q, bias, last = inertial.attitude_of(rows, q, bias, last)
        return out, (*map(float, q), *map(float, bias), int(last))

    state = "w double, x double, y double, z double, bx double, by double, bz double, t long"
    return folded_in_order(imu.select("stream", "seq", "t", *inertial.RAW), ["stream"], ["t", "seq"], fold, state, inertial.ATTITUDE, delay)


def full_times(words: DataFrame, delay: str = "1 second", jitter_us: int = 0) -> DataFrame:
    """The decoder's clock on a stream of words (stream, packet_id, pos, kind, payload, and `t`, when their packet was
    received): t, y and the rollovers so far of every word, with the last high and low time, rollover count and y of each
    stream as state. The batch form is operators.decode.full_time. Packets are decoded in order of their numbers; a packet may
    be received up to `jitter_us` before one with a smaller number."""

    def fold(rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        high, low, turns, y = past or (None, 0, 0, None)
        kind, payload = rows["kind"].to_numpy(np.int64), rows["payload"].to_numpy(np.int64)

        def newest(before: int | None, own: int, mask: int = -1) -> tuple[np.ndarray, np.ndarray]:
            """The last payload of a kind up to each word, and whether there is one."""
            n = np.cumsum(kind == own)
            return np.r_[before or 0, payload[kind == own] & mask][n], (n > 0) | (before is not None)

        highs, known = newest(high, 8)
        lows, _ = newest(low, 6)
        ys, placed = newest(y, 0, 0x7FF)
        fell = np.r_[highs[0] if high is None else high, highs[:-1]] - 10 > highs
        fell &= known & np.r_[high is not None, known[:-1]]
        turned = turns + np.cumsum(fell)
        times = (turned << 24) + (highs << 12) + lows
        out = pd.DataFrame({"stream": rows["stream"].to_numpy(), "packet_id": rows["packet_id"].to_numpy(), "pos": rows["pos"].to_numpy(), "t": pd.arrays.IntegerArray(times, ~known), "y": pd.arrays.IntegerArray(ys, ~placed), "rollovers": turned})
        return out, (int(highs[-1]) if known[-1] else None, int(lows[-1]), int(turned[-1]), int(ys[-1]) if placed[-1] else None)

    rows = words.select("stream", "packet_id", "pos", "kind", "payload", "t")
    return folded_in_order(rows, ["stream"], ["packet_id", "pos"], fold, "high long, low long, turns long, y long", "stream long, packet_id long, pos long, t long, y long, rollovers long", delay, jitter_us=jitter_us)


def packet_time(events: DataFrame, delay: str = "1 second", jitter_us: int = 100_000) -> DataFrame:
    """Times that never fall, in stream order (seq): the running maximum is the state. jitter_us: how far an event's time may lie
    behind that of one with a smaller seq."""

    def fold(rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        raw = rows["t"].to_numpy(np.int64)
        t = np.maximum.accumulate(np.r_[list(past or ()), raw].astype(np.int64))[-len(raw) :]
        return pd.DataFrame({"stream": rows["stream"].to_numpy(), "seq": rows["seq"].to_numpy(), "raw_t": raw, "t": t}), (int(t[-1]),)

    return folded_in_order(events.select("stream", "seq", "t"), ["stream"], ["seq"], fold, "top long", "stream long, seq long, raw_t long, t long", delay, jitter_us=jitter_us)


def fit_gate(fits: DataFrame, max_change: float = 0.3, hold_us: int = 500_000, delay: str = "1 second") -> DataFrame:
    """The gate over floor fits with its accepted slopes and last fit as state of each stream, which goes once the watermark is
    over the hold behind the last frame."""

    def fold(rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        gate = floor.Gate(max_change, hold_us)
        if past:
            slopes, *last, t = past
            gate.slopes, gate.last, gate.last_t = list(slopes), None if t is None else tuple(last), t
        out = floor.gate_rows(gate, rows)
        return out, ([float(s) for s in gate.slopes], *(gate.last or (None, None, None)), gate.last_t)

    rows = fits.select("stream", "frame_id", "t", "slope", "shift", "tolerance")
    return folded_in_order(rows, ["stream"], ["t", "frame_id"], fold, "slopes array<double>, slope double, shift double, tolerance double, t long", floor.FIT_STATE, delay, forget_us=hold_us)


def latest_value(stream: DataFrame, keys: list[str], order: list[str], name: str = "latest") -> DataFrame:
    """The newest row of each key: the stream in update mode, each batch's changes written as a table, newest kept."""
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    spark = stream.sparkSession
    out = new_folder(spark, name)
    agg = stream.groupBy(*keys).agg(newest)
    agg.writeStream.outputMode("update").option("checkpointLocation", new_folder(spark, f"{name}-state")).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*keys, "r.*").groupBy(*keys).agg(newest).select(*keys, "r.*")


#: A cell of the nearest match, in widths.
CELLS = 256


def nearest(left: DataFrame, right: DataFrame, width_us: int, delay: str = "0 seconds") -> DataFrame:
    """For each left row the nearest right row (ties: the older, then the smaller seq); null where none lies within the width.

    A left row waits at the time `width_us` behind its own, in order with the right rows, for the watermark of the slower source;
    then all that could be nearest has been seen, and the right rows of the last two widths are the state. So no pair of rows is
    made but the nearest. Keys are streams in cells of time, which are dealt to tasks and forgotten; right rows near a cell's border
    are copied to the next one."""
    span = CELLS * max(1, width_us)
    cell = lambda c: F.floor(c / span)
    t = F.col("t")
    reach = F.array_distinct(F.array(cell(t - width_us), cell(t + width_us)))
    a = marked(left.filter("t is not null").select("stream", cell(t).alias("cell"), F.lit(2).alias("side"), "seq", "t"), delay).withColumn("t", t + width_us)
    b = marked(right.filter("t is not null").select("stream", F.explode(reach).alias("cell"), F.lit(1).alias("side"), "seq", "t"), delay)

    def fold(rows: pd.DataFrame, past: tuple | None) -> tuple[pd.DataFrame, tuple]:
        side, seq, t = (rows[c].to_numpy(np.int64) for c in ("side", "seq", "t"))
        bt, bs = (np.r_[np.array(old, np.int64), own[side == 1]] for old, own in zip(past or ((), ()), (t, seq), strict=True))
        first = np.diff(bt, prepend=bt[:1] - 1) > 0  # the smallest seq of a time
        bt, bs = bt[first], bs[first]
        at = t[side == 2] - width_us
        ahead = np.searchsorted(bt, at, "right")
        far = np.iinfo(np.int64).max // 2
        times = np.r_[-far, bt, far]
        place = np.where(at - times[ahead] <= times[ahead + 1] - at, ahead - 1, ahead)
        none = np.abs(times[place + 1] - at) > width_us
        found = lambda c: pd.arrays.IntegerArray(np.r_[c, 0][np.where(none, len(c), place)], none)
        out = pd.DataFrame({"stream": rows["stream"].to_numpy()[side == 2], "a_seq": seq[side == 2], "a_t": at, "b_seq": found(bs), "b_t": found(bt)})
        near = bt >= t[-1] - 2 * width_us
        return out, (bt[near].tolist(), bs[near].tolist())

    return folded_in_order(a.unionByName(b), ["stream", "cell"], ["t", "side", "seq"], fold, "t array<long>, seq array<long>", "stream long, a_seq long, a_t long, b_seq long, b_t long", delay, forget_us=0)
