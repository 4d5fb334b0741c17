"""Packed event words as events.

A packet is a run of 16-bit little-endian words; the upper 4 bits say what the lower 12 are. Words become rows, and all
state (the clock, the current row of the sensor, the base of a vector) is a running value over (stream, packet, pos).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions.scan import running

#: Word kinds of the format.
ADDR_Y, ADDR_X, VECT_BASE_X, VECT_12, VECT_8, TIME_LOW, TIME_HIGH = 0, 2, 3, 4, 5, 6, 8
#: A high time this much below the one before is jitter and no rollover.
JITTER = 10
ORDER = ["packet_id", "pos"]


def packet_words(packets: DataFrame) -> DataFrame:
    """stream, packet_id, pos, kind, payload from the binary column `words`. An odd last byte is ignored."""
    n = F.floor(F.length("words") / 2).cast("int")
    rows = packets.filter(n > 0).withColumn("pos", F.explode(F.sequence(F.lit(0), n - 1)))
    byte = lambda at: F.conv(F.hex(F.substring("words", at, 1)), 16, 10).cast("int")
    word = byte(F.col("pos") * 2 + 1) + byte(F.col("pos") * 2 + 2) * 256
    return rows.select("stream", "packet_id", "pos", F.shiftright(word, 12).alias("kind"), word.bitwiseAND(0xFFF).alias("payload"))


def low_time(words: DataFrame) -> DataFrame:
    """`t` from low times alone: 4096 more whenever they fall inside a packet; words before the first one take it."""
    own = Window.partitionBy("stream", "packet_id").orderBy("pos")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    low = F.when(F.col("kind") == TIME_LOW, F.col("payload"))
    df = words.withColumn("_low", low).withColumn("_prev", F.last("_low", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_wraps", F.sum(F.when(F.col("_low") < F.col("_prev"), 1).otherwise(0)).over(upto))
    first = F.first("_low", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = F.coalesce(F.last("_low", ignorenulls=True).over(upto), first) + F.col("_wraps") * 4096
    return df.withColumn("t", t.cast("long")).drop("_low", "_prev", "_wraps")


def full_time(words: DataFrame) -> DataFrame:
    """`t` from high and low times and the sensor row `y`, all of which go on over packets; the clock starts anew every
    2^24 us. Inside a packet all is a window; what packets hand on is a scan over one row a packet."""
    inside = Window.partitionBy("stream", "packet_id").orderBy("pos")
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    fell = lambda now, prev: F.when(now < prev - JITTER, 1).otherwise(0).cast("long")
    df = words.withColumns({"_h": F.when(F.col("kind") == TIME_HIGH, F.col("payload")), "_l": F.when(F.col("kind") == TIME_LOW, F.col("payload")), "_y": F.when(F.col("kind") == ADDR_Y, F.col("payload").bitwiseAND(0x7FF))})
    df = df.withColumn("_w", fell(F.col("_h"), last("_h", before)))
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    packets = df.groupBy("stream", "packet_id").agg(F.min_by("_h", F.when(F.col("_h").isNotNull(), F.col("pos"))).alias("first_h"), newest("_h").alias("last_h"), newest("_l").alias("last_l"), newest("_y").alias("last_y"), F.sum("_w").alias("w"))
    earlier = Window.partitionBy("stream").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, -1)
    packets = packets.withColumns({"c_h": last("last_h", earlier), "c_l": last("last_l", earlier), "c_y": last("last_y", earlier)})
    packets = packets.withColumn("edge", fell(F.col("first_h"), F.col("c_h")))
    packets = packets.withColumn("c_w", F.coalesce(F.sum(F.col("w") + F.col("edge")).over(earlier), F.lit(0)))
    df = df.withColumns({"_nw": F.sum("_w").over(upto), "_nh": last("_h", upto), "_nl": last("_l", upto), "_ny": last("_y", upto)})
    df = df.join(packets.select("stream", "packet_id", "c_h", "c_l", "c_y", "c_w", "edge"), ["stream", "packet_id"])
    high = F.when(F.col("_nh").isNotNull(), (F.col("c_w") + F.col("_nw") + F.col("edge")) * 4096 + F.col("_nh")).otherwise(F.col("c_w") * 4096 + F.coalesce("c_h", F.lit(0)))
    out = {"t": high.cast("long") * 4096 + F.coalesce("_nl", "c_l", F.lit(0)), "y": F.coalesce("_ny", "c_y")}
    return df.withColumns(out).select(*words.columns, "t", "y")


def sensor_row(words: DataFrame) -> DataFrame:
    """`y`: the sensor row that the last row word set in the packet."""
    y = F.when(F.col("kind") == ADDR_Y, F.col("payload").bitwiseAND(0x7FF))
    return words.withColumn("y", F.last(y, ignorenulls=True).over(Window.partitionBy("stream", "packet_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))


def _xp(payload: Column) -> tuple[Column, Column]:
    return payload.bitwiseAND(0x7FF), F.shiftright(payload, 11).bitwiseAND(1)


def decode_single(words: DataFrame) -> DataFrame:
    """Events of single-pixel words; those before any row word go."""
    x, p = _xp(F.col("payload"))
    return words.filter((F.col("kind") == ADDR_X) & F.col("y").isNotNull()).select("stream", "packet_id", "pos", F.lit(0).alias("bit"), "t", x.alias("x"), "y", p.alias("p"))


def _with_base(words: DataFrame) -> DataFrame:
    """`_moved`: how far all vectors before a word have moved; `_base`: the governing base word; `_any`: the packet has one."""
    own = Window.partitionBy("stream", "packet_id").orderBy("pos")
    is_base = F.col("kind") == VECT_BASE_X
    width = F.when(F.col("kind") == VECT_12, 12).when(F.col("kind") == VECT_8, 8).otherwise(0)
    x, p = _xp(F.col("payload"))
    moved = F.coalesce(F.sum(width).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = words.withColumns({"_moved": moved, "_any": F.bool_or(is_base).over(Window.partitionBy("stream", "packet_id"))})
    base = F.when(is_base, F.struct(x.alias("x"), p.alias("p"), F.col("_moved").alias("m")))
    return df.withColumn("_base", F.last(base, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)))


def _emitted(df: DataFrame) -> DataFrame:
    """The events of each word, from its `bit` numbers (one 0 for a single pixel)."""
    x, p = _xp(F.col("payload"))
    single = F.col("kind") == ADDR_X
    at = F.coalesce("_base.x", F.lit(0)) + F.col("_moved") - F.coalesce("_base.m", F.lit(0)) + F.col("bit")
    return df.select("stream", "packet_id", "pos", "bit", "t", F.when(single, x).otherwise(at).cast("int").alias("x"), "y", F.when(single, p).otherwise(F.coalesce("_base.p", F.lit(0))).alias("p"))


def _set_bits() -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(11)), lambda b: F.getbit(F.col("payload").cast("long"), b) == 1)


def decode_vector(words: DataFrame) -> DataFrame:
    """Events of vector words: one for every set bit, from the base on; each vector moves the base by its width. A packet
    without base words gives none; vectors before its first base count from 0 with polarity 0."""
    df = _with_base(words).filter(F.col("kind").isin(VECT_12, VECT_8) & F.col("_any") & F.col("y").isNotNull())
    return _emitted(df.withColumn("bit", F.explode(_set_bits())))


def decode_words(words: DataFrame) -> DataFrame:
    """The events of `decode_single` and `decode_vector` together, in one pass over the words."""
    bits = F.when(F.col("kind") == ADDR_X, F.array(F.lit(0))).when(F.col("kind").isin(VECT_12, VECT_8) & F.col("_any"), _set_bits())
    return _emitted(_with_base(words).filter(F.col("y").isNotNull()).withColumn("bit", F.explode(bits)))


def decode(packets: DataFrame, mode: str = "packet") -> DataFrame:
    """All events in stream order (packet_id, pos, bit). In `packet` mode every packet stands alone and has low times
    only; in `absolute` and `sensor` mode the clock and the row go on."""
    words = packet_words(packets)
    return decode_words(sensor_row(low_time(words)) if mode == "packet" else full_time(words))


def anchor_time(events: DataFrame, packets: DataFrame, mode: str, use_bag_time: bool = False) -> DataFrame:
    """Event times moved to their packets' anchors: each packet's first event (`packet`), or all by the shift of the
    first packet that yields an event (`absolute`), or not at all (`sensor`)."""
    if mode == "sensor":
        return events
    anchor = F.col("bag_time_us") if use_bag_time else F.floor(F.col("time_base_ns") / 1000).cast("long")
    anchors = packets.select("stream", "packet_id", anchor.alias("_a"))
    if mode == "packet":
        first = F.first("t").over(Window.partitionBy("stream", "packet_id").orderBy("pos", "bit"))
        return events.withColumn("_first", first).join(anchors, ["stream", "packet_id"]).withColumn("t", F.col("t") + F.col("_a") - F.col("_first")).drop("_first", "_a")
    first = events.groupBy("stream", "packet_id").agg(F.min_by("t", F.struct("pos", "bit")).alias("_first"))
    shift = first.join(anchors, ["stream", "packet_id"]).withColumn("_shift", F.col("_a") - F.col("_first"))
    if mode == "absolute":
        one = shift.groupBy("stream").agg(F.min_by("_shift", "packet_id").alias("_shift"))
        return events.join(one, "stream").withColumn("t", F.col("t") + F.col("_shift")).drop("_shift")
    raise ValueError(f"unknown mode {mode}")


def monotonic_time(events: DataFrame, order: list[str], buckets: int | None = None, bucket: str | None = None) -> DataFrame:
    """`t` never falls in stream order: the running maximum; `raw_t` keeps what it was."""
    return running(events.withColumnRenamed("t", "raw_t"), ["stream"], order, "max", F.col("raw_t"), "t", buckets, bucket)


def adjusted_count(monotonic: DataFrame) -> DataFrame:
    return monotonic.groupBy("stream").agg(F.count_if(F.col("t") != F.col("raw_t")).alias("adjusted"), F.count("*").alias("n"))


def unsupported(packets: DataFrame, encodings: tuple[str, ...] = ("evt3",)) -> DataFrame:
    """Packets of encodings that aren't decoded, counted."""
    return packets.filter(~F.col("encoding").isin(*encodings)).groupBy("stream", "encoding").agg(F.count("*").alias("n"))
