"""Which packets come too late: a packet is accepted if no accepted one before it is newer than its first event.

Acceptance depends on earlier acceptance, but only through one link: behind an accepted packet the next accepted one is the
first that begins at or after its last event. So the accepted packets are the path from a stream's first packet along those
links. Links are found by range lookups and the path by list ranking, so one long stream runs in many tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.functions.scan import bucketed, reached
from photonlake.functions.search import first_at_least, path_ends
from photonlake.functions.shared import dropped, spread, stored

ROWS = 250_000
FIRST = -(1 << 63)
LINKS = "stream long, _bucket int, v long, to int, v2 long"


def _nexts(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's packets in order, their first and last times, and for each the place of the next one it lets in."""
    part = part.sort_values(["seq", "packet_id"])
    lo, hi = part["t_lo"].to_numpy(np.int64), part["t_hi"].to_numpy(np.int64)
    return part, lo, hi, first_at_least(lo, np.arange(1, len(lo) + 1), hi)


def _packed(key: tuple, columns: dict[str, object]) -> pd.DataFrame:
    out = pd.DataFrame(columns)
    return out.assign(stream=pd.Series([key[0]] * len(out), dtype="Int64"))


def late_packets(packets: DataFrame, buckets: int | None = None) -> DataFrame:
    """stream, packet_id and whether a packet (t_lo to t_hi, in order of arrival `seq`) is accepted. Packets without times are
    not, and let all others be as they are.

    Inside a bucket of arrivals a path is followed in place. What leaves it is the last time `v` of its last packet there,
    and enters the first later bucket that has a packet from v on; so (bucket, v) are the nodes that are ranked, a few for
    each bucket unless packets are longer than buckets."""
    known = packets.select("stream", "packet_id", "seq", "t_lo", "t_hi").withColumn("_no", F.col("t_lo").isNull() | F.col("t_hi").isNull())
    timed = known.filter(~F.col("_no")).drop("_no")
    rows = bucketed(timed, ["stream"], "seq", buckets or max(1, math.ceil(packets.count() / ROWS)))

    def leave(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """The times that leave a bucket, and the latest beginning in it."""
        part, lo, hi, nxt = _nexts(part)
        v = np.unique(hi[nxt == len(lo)])
        return _packed(key, {"_bucket": np.full(len(v), key[1], np.int32), "v": v, "most": np.full(len(v), lo.max())})

    left = stored(spread(rows, "stream", "_bucket").groupBy("stream", "_bucket").applyInPandas(leave, "stream long, _bucket int, v long, most long"), "exits")

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Of one stream's buckets (a row for each time that leaves one): which bucket each time enters."""
        most = part.groupby("_bucket")["most"].first().sort_index()
        number = most.index.to_numpy()
        at = first_at_least(most.to_numpy(), np.searchsorted(number, part["_bucket"].to_numpy(), "right"), part["v"].to_numpy(np.int64))
        ok = at < len(number)
        own = pd.DataFrame({"_bucket": part["_bucket"].to_numpy()[ok], "v": part["v"].to_numpy()[ok], "to": number[at[ok]]})
        begin = pd.DataFrame({"_bucket": [-1], "v": [FIRST], "to": number[:1]})
        return _packed(key, pd.concat([begin, own], ignore_index=True).astype({"_bucket": "int32", "v": "int64", "to": "int32"}))

    enters = stored(left.groupBy("stream").applyInPandas(meet, "stream long, _bucket int, v long, to int"), "entries")
    dropped(left)

    def link(key: tuple, part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        """Behind which time a path leaves the bucket that it enters behind time v."""
        part, lo, hi, nxt = _nexts(part)
        v = wanted["v"].to_numpy(np.int64)
        last = path_ends(nxt)[first_at_least(lo, np.zeros(len(v), np.int64), v)] if len(v) else v
        return _packed(key, {"_bucket": wanted["_bucket"].to_numpy(), "v": v, "to": wanted["to"].to_numpy(), "v2": hi[last]})

    at = enters.withColumnRenamed("_bucket", "_from").withColumn("_at", F.col("to"))
    links = spread(rows, "stream", "_bucket").groupBy("stream", "_bucket").cogroup(at.withColumnRenamed("_from", "_bucket").groupBy("stream", "_at")).applyInPandas(link, LINKS)
    links = stored(links, "links")
    longest = rows.select("_bucket").distinct().count()
    starts = links.filter("_bucket = -1").select("stream", "_bucket", "v")
    used = reached(links, starts, ["stream"], ["_bucket", "v"], ["to", "v2"], longest)
    dropped(links)
    # a node on the path is left at its time; where it leads to is what is entered
    entered = used.join(enters.withColumnsRenamed({"stream": "_s", "_bucket": "_b", "v": "_v"}), F.col("stream").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")) & (F.col("v") == F.col("_v"))).select("stream", F.col("to").alias("_at"), "v")

    def mark(key: tuple, part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        part, lo, _, nxt = _nexts(part)
        accepted = np.zeros(len(lo), bool)
        if len(entry):
            at, follow = int(first_at_least(lo, np.zeros(1, np.int64), entry["v"].to_numpy(np.int64)[:1])[0]), nxt.tolist()
            path = []
            while at < len(lo):
                path.append(at)
                at = follow[at]
            accepted[path] = True
        return _packed(key, {"packet_id": part["packet_id"].to_numpy(), "accepted": accepted})

    out = spread(rows, "stream", "_bucket").groupBy("stream", "_bucket").cogroup(entered.groupBy("stream", "_at")).applyInPandas(mark, "stream long, packet_id long, accepted boolean")
    return out.unionByName(known.filter("_no").select(F.col("stream").cast("long").alias("stream"), F.col("packet_id").cast("long").alias("packet_id"), F.lit(False).alias("accepted")))
