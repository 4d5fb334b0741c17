"""Windows over events, and the frames they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake.functions.scan import null_safe, rank

WIN = ("stream", "win")


def tumbling(events: DataFrame, width_us: int, origin: int | None = None) -> DataFrame:
    """Events with `win`, the number of the half-open interval they lie in, from the origin or the stream's first event."""
    if origin is not None:
        return events.withColumn("win", F.floor((F.col("t") - origin) / width_us))
    first = events.groupBy("stream").agg(F.min("t").alias("_t0"))
    return null_safe(events, first, ["stream"]).withColumn("win", F.floor((F.col("t") - F.col("_t0")) / width_us)).drop("_t0")


def window_counts(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*WIN).agg(F.count("*").alias("n"))


def window_stats(windows: DataFrame, width_us: int, report_us: int = 5_000_000) -> DataFrame:
    """For each stream and report interval: windows, events, their mean, windows a second."""
    per = window_counts(windows).withColumn("report", F.floor(F.col("win") * width_us / report_us))
    out = per.groupBy("stream", "report").agg(F.count("*").alias("windows"), F.sum("n").alias("events"))
    return out.withColumns({"mean_events": F.col("events") / F.col("windows"), "windows_per_s": F.col("windows") / (report_us / 1e6)})


def every_nth_window(windows: DataFrame, stride: int) -> DataFrame:
    return windows.filter(F.col("win") % stride == 0)


def gate_min_events(windows: DataFrame, least: int) -> DataFrame:
    """Events of windows that hold at least `least` (and two) events."""
    return windows.join(window_counts(windows).filter(F.col("n") >= max(2, least)).select(*WIN), list(WIN), "left_semi")


def gated_windows(windows: DataFrame, least: int) -> DataFrame:
    return window_counts(windows).groupBy("stream").agg(F.count_if(F.col("n") < max(2, least)).alias("gated"), F.count("*").alias("windows"))


def decimate(windows: DataFrame, most: int) -> DataFrame:
    """Of a window with n > most events those at floor(i * n / most), i = 0 .. most - 1."""
    order = Window.partitionBy(*WIN).orderBy("t", "seq")
    df = windows.withColumns({"_r": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(*WIN))})
    i = F.floor((F.col("_r") * most + F.col("_n") - 1) / F.col("_n"))
    keep = (F.col("_n") <= most) | ((i < most) & (F.floor(i * F.col("_n") / most) == F.col("_r")))
    return df.filter(keep).drop("_r", "_n")


def normalize_events(windows: DataFrame, width: int, height: int, window_us: int) -> DataFrame:
    """x and y as shares of the sensor, age before the window's newest event as a share of the window, p as 0 or 1."""
    newest = F.max("t").over(Window.partitionBy(*WIN))
    age = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (newest - F.col("t")) / window_us))
    return windows.select(*WIN, "seq", (F.col("x") / width).alias("nx"), (F.col("y") / height).alias("ny"), age.alias("age"), F.col("p").cast("double").alias("pol"))


def pack_windows(features: DataFrame) -> DataFrame:
    """One matrix (rows in order of age, newest last, then seq) and count for each window."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("k"), "seq", "nx", "ny", "age", "pol")))
    return features.groupBy(*WIN).agg(F.transform(rows, lambda r: F.array(r["nx"], r["ny"], r["age"], r["pol"])).alias("matrix"), F.count("*").alias("n"))


def polarity_frame(windows: DataFrame) -> DataFrame:
    """Colour of every pixel that fired: green if any event was negative, else red."""
    return windows.groupBy(*WIN, "y", "x").agg(F.when(F.bool_or(F.col("p") == 0), "green").otherwise("red").alias("colour"))


def event_histogram(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*WIN, "y", "x").agg(F.count_if(F.col("p") == 1).alias("n_on"), F.count_if(F.col("p") == 0).alias("n_off"))


def dense_frame(windows: DataFrame, width: int, height: int) -> DataFrame:
    """One array of width * height counts for each window, row by row, 0 where nothing fired: the counts in order, each
    behind as many zeros as cells were passed over. Events off the sensor don't count."""
    on = windows.filter(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1))
    fired = on.groupBy(*WIN, (F.col("y") * width + F.col("x")).cast("int").alias("i")).agg(F.count("*").alias("n"))
    cells = fired.groupBy(*WIN).agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("m"))
    zeros = lambda n: F.array_repeat(F.lit(0).cast("long"), n.cast("int"))
    part = lambda c, k: F.concat(zeros(c["i"] - F.when(k > 0, F.get("m", k - 1)["i"]).otherwise(-1) - 1), F.array(c["n"]))
    return cells.select(*WIN, F.concat(F.flatten(F.transform("m", part)), zeros(width * height - 1 - F.element_at("m", -1)["i"])).alias("frame"))


def subsample(df: DataFrame, most: int, buckets: int | None = None) -> DataFrame:
    """Every max(1, n div most)-th row of each stream in time order."""
    n = df.groupBy("stream").agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("_step"))
    return rank(df, ["stream"], ["t", "seq"], "_r", buckets).join(n, "stream").filter(F.col("_r") % F.col("_step") == 0).drop("_r", "_step")


def activity_by_polarity(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*WIN).agg(F.count_if(F.col("p") == 1).alias("n_on"), F.count_if(F.col("p") == 0).alias("n_off"), F.count("*").alias("n"))


def activity_total(activity: DataFrame) -> DataFrame:
    """One row: windows and events over all streams."""
    return activity.agg(F.count("*").alias("windows"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_on", "n_off", "n")))
