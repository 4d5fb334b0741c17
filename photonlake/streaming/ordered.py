"""Recursions over a stream whose rows arrive in any order: a reorder buffer in state, let go by event-time timers.

A key's rows wait in list state until the watermark says that no earlier one can come, and are then folded in order into a value
state. So the result doesn't depend on files, batches or arrival, as long as no row is later than the watermark's delay (Spark
drops those). The state lives in RocksDB (`transformWithState` needs that provider). Rows wait in sorted chunks, packed, and of
these only the ones that are let go are unpacked, one after the other: memory is bounded by chunks whose rows overlap, and by the
packed bytes of what one key has waiting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Spark's first watermark is the epoch and rows at or before it are late; times are moved by a day, so a stream may begin there.
SHIFT_US = 86_400_000_000

#: Sorted rows and the state so far (None at first) to the output rows and the new state.
Fold = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


def keep_state_on_disk(spark: SparkSession) -> None:
    """State in RocksDB, unless the session names another provider that keeps more than one column family."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKS)


#: Rows of a chunk, and how many arriving rows are sorted at once.
CHUNK, RUN = 50_000, 500_000


def packed(rows: pd.DataFrame, schema: pa.Schema) -> bytes:
    """Rows as Parquet: whole numbers in order by their differences, so that a waiting row takes a few bytes."""
    delta = {f.name: "DELTA_BINARY_PACKED" for f in schema if pa.types.is_integer(f.type)}
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, schema=schema, preserve_index=False)
    pq.write_table(table, out, compression="zstd", use_dictionary=False, write_statistics=False, store_schema=False, column_encoding=delta or None)
    return out.getvalue().to_pybytes()


def unpacked(chunk: bytes) -> pd.DataFrame:
    return pq.read_table(pa.BufferReader(chunk), use_threads=False).to_pandas()


def _below(rows: pd.DataFrame, order: list[str], place: tuple) -> int:
    """How many of the sorted rows lie before a place."""
    less, same = False, True
    for c, value in zip(order, place, strict=True):
        less, same = less | (same & (rows[c] < value)), same & (rows[c] == value)
    return int(less.sum())


class InOrder(StatefulProcessor):
    """Folds each key's rows by `order`. A row is ready once the watermark has reached its time plus `jitter_us`; the ready rows
    before the first one that isn't are let go."""

    def __init__(self, waiting: StructType, state: str, fold: Fold, order: list[str], time: str, jitter_us: int, forget_us: int | None):
        self.schema, self.state, self.fold, self.order, self.time, self.jitter_us, self.forget_us = waiting, state, fold, order, time, jitter_us, forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrow = to_arrow_schema(self.schema)
        #: a chunk: its first row's place in order, and its rows
        self.waiting = handle.getListState("waiting", StructType([*(StructField(f"at{k}", self.schema[c].dataType) for k, c in enumerate(self.order)), StructField("chunk", BinaryType())]))
        self.folded = handle.getValueState("folded", self.state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, run, n = [], [], 0
        for part in rows:
            run.append(part[self.schema.names])
            n += len(part)
            if n >= RUN:
                new += self._chunks(pd.concat(run, ignore_index=True).sort_values(self.order, ignore_index=True))
                run, n = [], 0
        if n:
            new += self._chunks(pd.concat(run, ignore_index=True).sort_values(self.order, ignore_index=True))
        del run
        yield from self._let_go(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._let_go([], timerValues.getCurrentWatermarkInMs())

    def _chunks(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            out.append((*(part[c].iloc[0].item() for c in self.order), packed(part, self.arrow)))
        return out

    def _let_go(self, new: list[tuple], mark_ms: int) -> Iterator[pd.DataFrame]:
        held = [tuple(c) for c in self.waiting.get()] if self.waiting.exists() else []
        if not held and not new:
            if self.forget_us is not None and self.folded.exists() and not list(self.handle.listTimers()):
                self.folded.clear()
            return
        had, chunks = bool(held), sorted(held + new, key=lambda c: c[:-1])
        del held, new
        past, last, rows = None, None, None  # rows: unpacked and not folded yet, in order
        for k, chunk in enumerate(chunks):
            own = unpacked(chunk[-1])
            rows = own if rows is None or not len(rows) else pd.concat([rows, own], ignore_index=True).sort_values(self.order, ignore_index=True)
            n = _below(rows, self.order, chunks[k + 1][:-1]) if k + 1 < len(chunks) else len(rows)
            due = rows[self.time][:n].astype("int64").to_numpy() + self.jitter_us + SHIFT_US
            stays = due > mark_ms * 1000
            stopped = bool(stays.any())
            n = int(stays.argmax()) if stopped else n
            if n:
                if past is None:
                    past = self.folded.get() if self.folded.exists() else None
                out, past = self.fold(rows[:n], past)
                last, rows = int(due[n - 1]), rows[n:].reset_index(drop=True)
                if len(out):
                    yield out
            if stopped:
                self.waiting.put(self._chunks(rows) + chunks[k + 1 :])
                self._wake(-(-int(due[n]) // 1000))
                break
        else:
            if had:
                self.waiting.clear()
            if self.forget_us is not None:
                self._wake(-(-(last + self.forget_us) // 1000) + 1)
        if last is not None:
            self.folded.update(past)

    def _wake(self, ms: int) -> None:
        if ms not in list(self.handle.listTimers()):
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def marked(rows: DataFrame, delay: str, time: str = "t") -> DataFrame:
    """Rows with the watermark that their fold waits for. Of several sources that are united afterwards the slowest one counts."""
    return rows.withColumn("_ts", F.timestamp_micros(F.col(time) + SHIFT_US)).withWatermark("_ts", delay)


def folded_in_order(rows: DataFrame, keys: list[str], order: list[str], fold: Fold, state: str, out: str, delay: str, time: str = "t", jitter_us: int = 0, forget_us: int | None = None) -> DataFrame:
    """`fold` over each key's rows of a stream, by `order`.

    A row is folded once the watermark (the latest time less `delay`) has reached its time plus `jitter_us`: by how much a row may
    lie behind in time what is before it in order. forget_us: the state goes when the watermark is that far behind the last row
    and none waits; otherwise it stays for good. Column names must not begin with an underscore, which row state can't hold. Rows that are `marked` already keep that
    watermark."""
    keep_state_on_disk(rows.sparkSession)
    waiting = StructType([f for f in rows.schema if f.name != "_ts"])
    known = rows if "_ts" in rows.columns else marked(rows, delay, time)
    return known.groupBy(*keys).transformWithStateInPandas(InOrder(waiting, state, fold, order, time, jitter_us, forget_us), out, "Append", "EventTime")
