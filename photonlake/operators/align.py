"""Aligning sensors in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonlake.functions.scan import bucketed, null_safe, running


def _together(left: DataFrame, right: DataFrame, value: str, buckets: int | None) -> DataFrame:
    """Both sides as rows of one stored, bucketed table: _l or _r holds the row. Right rows sort before left rows of one
    time, so equal times meet. Negated columns give the order backwards."""
    r = right.select("stream", F.col("t").alias("_t"), F.lit(0).alias("_side"), F.col("seq").alias("_o"), F.struct("t", F.col("seq").alias("rseq"), F.col(value).alias("value")).alias("_r"))
    l_ = left.select("stream", F.col("t").alias("_t"), F.lit(1).alias("_side"), F.col("seq").alias("_o"), F.struct(*(c for c in left.columns if c != "stream")).alias("_l"))
    both = r.withColumn("_l", F.lit(None).cast(l_.schema["_l"].dataType)).unionByName(l_.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
    return bucketed(both, ["stream"], "_t", buckets, "_cut").withColumns({"_back_t": -F.col("_t"), "_back_o": -F.col("_o"), "_back_cut": -F.col("_cut")})


def _newest(both: DataFrame, out: str) -> DataFrame:
    return running(both, ["stream"], ["_t", "_side", "_o"], "last", F.col("_r"), out, bucket="_cut")


def asof_backward(left: DataFrame, right: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """`left` with `value` of the newest right row at or before it (ties: the larger seq), and its time as `value_t`."""
    df = _newest(_together(left, right, value, buckets), "_b").filter("_side = 1").select("stream", "_l.*", "_b")
    return df.withColumns({value: F.col("_b.value"), "value_t": F.col("_b.t")}).drop("_b")


def asof_nearest(left: DataFrame, right: DataFrame, value: str, tolerance_us: int, default: Column | None = None, buckets: int | None = None) -> DataFrame:
    """`left` with `value` of the right row nearest in time, the older one on a tie, or the default beyond the tolerance. One
    stored table is looked through forwards and backwards."""
    df = _newest(_together(left, right, value, buckets), "_b")
    df = running(df, ["stream"], ["_back_t", "_side", "_back_o"], "last", F.col("_r"), "_f", bucket="_back_cut").filter("_side = 1").select("stream", "_l.*", "_b", "_f")
    back, ahead = F.col("t") - F.col("_b.t"), F.col("_f.t") - F.col("t")
    near = F.when(ahead.isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_f"))
    ok = F.abs(F.col("_n.t") - F.col("t")) <= tolerance_us
    df = df.withColumn("_n", near)
    chosen = F.when(ok, F.col("_n.value"))
    return df.withColumns({value: F.coalesce(chosen, default) if default is not None else chosen, "value_t": F.when(ok, F.col("_n.t"))}).drop("_b", "_f", "_n")


#: Rows of the left side that one task matches.
DENSE = 100_000


def interval_match(a: DataFrame, b: DataFrame, width_us: int, dense: int = DENSE) -> DataFrame:
    """All pairs of one stream at most `width_us` apart: an equality join on time cells, b's rows in three cells each.

    A cell with over `dense` rows of `a`, a burst, is cut into parts of about that many, by time and then by seq: an approximate
    quantile sketch of the cell gives the cuts. b's rows go to the parts whose times they can reach, so a burst runs in many tasks
    and pairs stay what they are."""
    left = a.select("stream", F.col("seq").alias("a_seq"), F.col("t").alias("a_t"), F.floor(F.col("t") / width_us).alias("_c"))
    cells = F.explode(F.array(*(F.floor(F.col("t") / width_us) + k for k in (-1, 0, 1))))
    right = b.select("stream", F.col("seq").alias("b_seq"), F.col("t").alias("b_t"), cells.alias("_c"))
    crowded = left.groupBy("stream", "_c").agg(F.count("*").alias("_n")).filter(F.col("_n") > dense)
    near = lambda both: both.filter(F.abs(F.col("a_t") - F.col("b_t")) <= width_us).select("stream", "a_seq", "b_seq", "a_t", "b_t")
    if crowded.isEmpty():
        return near(null_safe(left, right, ["stream", "_c"]))
    # a row's part: how many cuts lie at or below its time; rows of a part are dealt by seq
    cuts = null_safe(left, crowded, ["stream", "_c"]).groupBy("stream", "_c").agg(F.percentile_approx("a_t", [k / 16 for k in range(1, 16)], 1000).alias("_cuts"), F.first("_n").alias("_n"))
    cuts = cuts.withColumns({"_deal": F.greatest(F.lit(1), F.ceil(F.col("_n") / 16 / dense)).cast("int"), "_cuts": F.array_distinct("_cuts")})
    below = lambda t: F.size(F.filter("_cuts", lambda c: c <= t))
    left = null_safe(left, cuts, ["stream", "_c"], "left")
    left = left.withColumns({"_part": F.coalesce(below(F.col("a_t")), F.lit(0)), "_dealt": F.coalesce(F.pmod(F.xxhash64("a_seq"), F.col("_deal")).cast("int"), F.lit(0))}).drop("_cuts", "_deal", "_n")
    right = null_safe(right, cuts, ["stream", "_c"], "left")
    reach = F.sequence(below(F.col("b_t") - width_us), below(F.col("b_t") + width_us))
    right = right.withColumn("_part", F.explode(F.coalesce(reach, F.array(F.lit(0))))).withColumn("_dealt", F.explode(F.coalesce(F.sequence(F.lit(0), F.col("_deal") - 1), F.array(F.lit(0))))).drop("_cuts", "_deal", "_n")
    return near(null_safe(left, right, ["stream", "_c", "_part", "_dealt"]))


def valid_ranges(ranges: DataFrame) -> DataFrame:
    """Finite positive readings within the sensor's limits; limits that aren't ordered don't count."""
    v = F.col("rng")
    return ranges.filter(~F.isnan(v) & (v < float("inf")) & (v > 0) & ((F.col("max_range") <= F.col("min_range")) | v.between(F.col("min_range"), F.col("max_range"))))


def gravity_direction(odom: DataFrame) -> DataFrame:
    """The world's down direction in the optical frame (x right, y down, z ahead) of a level forward camera."""
    w, x, y, z = (F.col(c) for c in ("qw", "qx", "qy", "qz"))
    n = w * w + x * x + y * y + z * z
    return odom.withColumns({"gx": 2 * (y * z + w * x) / n, "gy": (w * w - x * x - y * y + z * z) / n, "gz": 2 * (w * y - x * z) / n})


def vertical_height(ranges: DataFrame, odom: DataFrame, buckets: int | None = None) -> DataFrame:
    """Range times the y part of the newest gravity direction (1 before any), of valid readings."""
    df = asof_backward(valid_ranges(ranges), gravity_direction(odom), "gy", buckets)
    return df.withColumn("height", F.col("rng") * F.coalesce("gy", F.lit(1.0)))
