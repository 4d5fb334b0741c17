"""Where sequences of `width` units stand more than once: what substring and byte deduplication share.

A document is a sequence of units (bytes or words). Every window of `width` units has an anchor, its n-gram of `gram` units
with the smallest hash (the leftmost of equals), so equal windows have equal anchors at equal places. Consecutive windows
with one anchor form a block. The blocks of all documents are the reference; anchors index them:

* blocks are one class if the 128-bit digests of their units agree; all windows of a class with two members repeat, and each
  member learns its source, the class's first member;
* an anchor with one class decides its windows; an anchor with several classes leaves the windows of each class's first
  block OPEN, and those are handed on for an exact check.

Only about 2 / (width - gram + 2) of all positions are shuffled, packed into one binary row for each batch and bucket. A
class is reduced to its first member within a batch before anything is shuffled, so a passage that a third of all
documents share costs one entry a batch. An anchor that stands in ever new surroundings isn't reduced by that: of its
classes a batch sends `PER_BATCH`, and hands the others on as WIDE at once. WIDE windows, also those of anchors with over
`WIDE_CLASSES` classes, are checked each by its own digest, whose buckets no anchor can fill.

Rows are told apart by doc_id and a 64-bit hash of the text, so rows that share a doc_id keep their own runs; rows equal
in both have equal runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import byte_texts, id_text, mixed, slices

BASE = 0x9E3779B97F4A7C15
ENTRIES = 150_000  # aimed at for each bucket
PER_BATCH, WIDE_CLASSES = 16, 4096
DECIDED, OPEN, WIDE = 0, 1, 2
#: Which windows (first to last) of which row; key of the anchor; for decided ones the source and the first window there.
RUNS = "doc_id long, row long, lo long, hi long, kind int, key long, source long, at long"
FIELDS = [f.split()[0] for f in RUNS.split(", ")]
PACKED = "bucket int, part int, " + ", ".join(f"{c} binary" for c in ("doc", "row", "lo", "n", "key", "c0", "c1", "source", "at"))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Units(NamedTuple):
    """A document cut into units: hashes of the units, the bytes they stand in, and where each begins and ends."""

    values: np.ndarray
    body: bytes
    begin: np.ndarray
    end: np.ndarray


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64, for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(2 * n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    up, down = powers(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])


def sliding_argmin(g: np.ndarray, m: int) -> np.ndarray:
    """For each i the leftmost position of the minimum of g[i : i + m]."""
    v, p, span = g, np.arange(len(g)), 1
    while span < m:
        step = min(span, m - span)
        left = v[:-step] <= v[step:]
        v, p = np.where(left, v[:-step], v[step:]), np.where(left, p[:-step], p[step:])
        span += step
    return p


def blocks(u: Units, width: int, gram: int, key_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, hi (first and last window) and key (of the anchor) of every block of a document."""
    if len(u.values) < width:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    g = gram_hashes(u.values, gram)
    at = sliding_argmin(g, width - gram + 1)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo, hi = np.r_[0, cut], np.r_[cut - 1, len(at) - 1]
    return lo, hi, g[at[lo]] >> np.uint64(64 - key_bits)


def digests(u: Units, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """128 bits, as two columns, of the units of windows lo to hi."""
    digest, body = xxhash.xxh3_128_digest, u.body
    found = b"".join([digest(body[a:b]) for a, b in zip(u.begin[lo].tolist(), u.end[hi + width - 1].tolist(), strict=True)])
    return np.frombuffer(found, "<u8").reshape(-1, 2)


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal rank together, which the shuffle's compression likes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() if len(x) else b""


def from_planes(data: bytes | None, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind) if data else np.zeros(0, kind)


def unpacked(table: pa.Table, part: int, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The columns of one part of packed rows, as 64-bit integers."""
    own = table.filter(pc.equal(table.column("part"), part))
    return {c: np.concatenate([np.zeros(0, kind), *(from_planes(x, kind) for x in own.column(c).to_pylist())]).astype(kind[:2] + "8") for c, kind in kinds.items()}


def merged(runs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Touching runs of one row as one, where they go on in one source too."""
    order = np.lexsort((runs["lo"], runs["row"], runs["doc_id"]))
    runs = {c: x[order] for c, x in runs.items()}
    if not len(order):
        return runs
    lo, hi, offset = runs["lo"], runs["hi"], runs["at"] - runs["lo"]
    new = np.r_[True, (lo[1:] > hi[:-1] + 1)]
    for x in (runs["doc_id"], runs["row"], runs["source"], offset):
        new[1:] |= x[1:] != x[:-1]
    first = new.nonzero()[0]
    return {c: np.maximum.reduceat(x, first) if c == "hi" else x[first] for c, x in runs.items()}


def packed(bucket: np.ndarray, columns: dict[str, np.ndarray], part: int) -> pa.RecordBatch:
    """One row for each bucket; `bucket` need not be sorted, order within a bucket stays."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    groups = np.split(order, cut[1:]) if len(b) else []
    names = [f.split()[0] for f in PACKED.split(", ")[2:]]
    blobs = [pa.array([planes(columns[c][g]) for g in groups] if c in columns else [None] * len(groups), pa.binary()) for c in names]
    return pa.record_batch([pa.array(b[cut].astype(np.int32), pa.int32()), pa.array(np.full(len(groups), part, np.int32)), *blobs], ["bucket", "part", *names])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text) and text of the rows that take part. Every join goes by the same two keys, so the
    texts are shuffled once."""
    return id_text(docs).filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")


def bucket_count(docs: DataFrame, per_byte: float) -> int:
    """Buckets for about ENTRIES entries each, from the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, round(size * per_byte / ENTRIES))


def dealt(doc, row, lo, hi, key, cls, n: int, first_stays: bool, per_batch: int) -> Iterator[pa.RecordBatch]:
    """A batch's entries, in the order of doc and lo, as packed rows: part 0 the first of each class, part 1 the runs that
    the batch decides, part 2 the WIDE ones."""
    by = np.lexsort((np.arange(len(doc)), cls[:, 1], cls[:, 0]))
    same = (cls[by][1:] == cls[by][:-1]).all(1)
    start = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[start, len(by)])
    head = by[start]
    first = np.empty(len(doc), np.int64)
    first[by] = np.repeat(head, size)
    repeat = first != np.arange(len(doc))
    if first_stays:
        repeat &= (doc != doc[first]) | (lo != lo[first])
    else:  # the first one's source is the second
        again = size > 1
        first[head[again]] = by[start[again] + 1]
        repeat[head[again]] = True
    head = head[np.argsort(key[head], kind="stable")]
    begin = np.flatnonzero(np.r_[True, key[head][1:] != key[head][:-1]])
    count = np.diff(np.r_[begin, len(head)])
    place = np.arange(len(head)) - np.repeat(begin, count)
    hot = np.repeat(count, count) > per_batch
    to = np.sort(head[place < per_batch])
    flag = np.zeros(len(doc), np.int16)
    flag[head[hot]] = 1 << 14
    whole = lambda x: x.astype("<i8")
    yield packed((key[to] % np.uint64(n)).astype(np.int64), {"doc": whole(doc[to]), "row": whole(row[to]), "lo": lo[to].astype("<i4"), "n": ((hi - lo)[to] + flag[to]).astype("<i2"), "key": key[to], "c0": cls[to, 0], "c1": cls[to, 1]}, 0)
    if repeat.any():
        r = merged({"doc_id": doc[repeat], "row": row[repeat], "lo": lo[repeat], "hi": hi[repeat], "source": doc[first[repeat]], "at": lo[first[repeat]]})
        yield packed((mixed(r["row"].astype(np.uint64)) % np.uint64(n)).astype(np.int64), {"doc": whole(r["doc_id"]), "row": whole(r["row"]), "lo": r["lo"].astype("<i4"), "n": (r["hi"] - r["lo"]).astype("<i4"), "source": whole(r["source"]), "at": r["at"].astype("<i4")}, 1)
    wide = np.sort(head[place >= per_batch])
    if len(wide):
        yield packed((mixed(row[wide].astype(np.uint64)) % np.uint64(n)).astype(np.int64), {"doc": whole(doc[wide]), "row": whole(row[wide]), "lo": lo[wide].astype("<i4"), "n": (hi - lo)[wide].astype("<i4")}, 2)


ENTRY = {"doc": "<i8", "row": "<i8", "lo": "<i4", "n": "<i2", "key": "<u8", "c0": "<u8", "c1": "<u8"}
RUN = {"doc": "<i8", "row": "<i8", "lo": "<i4", "n": "<i4", "source": "<i8", "at": "<i4"}


def resolved(table: pa.Table, first_stays: bool, most: int) -> pa.Table:
    """Runs of one bucket."""
    out = []

    def put(doc, row, lo, hi, kind, key=None, source=None, at=None):
        none = np.zeros(len(doc), np.int64)
        out.append((doc, row, lo, hi, none + kind, none if key is None else key.view(np.int64), none if source is None else source, none if at is None else at))

    old = unpacked(table, 1, RUN)
    put(old["doc"], old["row"], old["lo"], old["lo"] + old["n"], DECIDED, None, old["source"], old["at"])
    wide = unpacked(table, 2, {c: RUN[c] for c in ("doc", "row", "lo", "n")})
    put(wide["doc"], wide["row"], wide["lo"], wide["lo"] + wide["n"], WIDE)
    e = unpacked(table, 0, ENTRY)
    by = np.lexsort((e["lo"], e["doc"], e["c1"], e["c0"], e["key"]))
    if len(by):
        doc, row, lo, n, key, c0, c1 = (x[by] for x in e.values())
        hot, n = n >> 14 > 0, n & ((1 << 14) - 1)
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1])]
        start = new.nonzero()[0]
        size = np.diff(np.r_[start, len(by)])
        first = np.repeat(start, size)
        repeat = first != np.arange(len(by))
        if first_stays:
            repeat &= (doc != doc[first]) | (lo != lo[first])
        else:
            again = size > 1
            first[start[again]] = start[again] + 1
            repeat[start[again]] = True
        put(doc[repeat], row[repeat], lo[repeat], (lo + n)[repeat], DECIDED, None, doc[first[repeat]], lo[first[repeat]])
        own = np.cumsum(new_key) - 1
        classes = np.bincount(own, weights=new)[own]
        more = np.bincount(own, weights=hot)[own] > 0  # classes that didn't come here
        broad = more | (classes > most)
        for kind, among in ((OPEN, (classes > 1) & ~broad), (WIDE, more | (classes > 1) & broad)):
            at = (new & among).nonzero()[0]
            put(doc[at], row[at], lo[at], (lo + n)[at], kind, key[at])
    cols = [np.concatenate([o[j] for o in out]) for j in range(8)]
    return pa.table([pa.array(x.astype(np.int32)) if c == "kind" else pa.array(x) for c, x in zip(FIELDS, cols, strict=True)], FIELDS)


def block_runs(docs: DataFrame, units: Callable[[bytes], Units], width: int, gram: int, per_byte: float, first_stays: bool, key_bits: int = 64, per_batch: int = PER_BATCH, most: int = WIDE_CLASSES) -> DataFrame:
    """RUNS of all blocks. first_stays: a class's first member (by doc_id, then place) counts as no repeat."""
    rows = keyed(docs).filter("text is not null")
    n = bucket_count(rows, per_byte)

    def emit(batches):
        for batch in slices(batches):
            order = np.argsort(batch.column("doc_id").to_numpy(), kind="stable")
            data, found = byte_texts(batch), []
            for k in order.tolist():
                u = units(data[k])
                lo, hi, key = blocks(u, width, gram, key_bits)
                found.append((lo, hi, key, digests(u, lo, hi, width)))
            lo, hi, key, cls = (np.concatenate([f[k] for f in found]) for k in range(4))
            if len(lo):
                doc, row = (np.repeat(batch.column(c).to_numpy()[order], [len(f[0]) for f in found]) for c in ("doc_id", "row"))
                yield from dealt(doc, row, lo, hi, key, cls, n, first_stays, per_batch)

    def resolve(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return resolved(table, first_stays, most)

    return rows.mapInArrow(emit, PACKED).groupBy("bucket").applyInArrow(resolve, RUNS)


def window_entries(found: list[tuple[int, int, Units, np.ndarray, np.ndarray]], width: int, n: int, first_stays: bool) -> Iterator[pa.RecordBatch]:
    """Packed rows of single windows, keyed by their own digests. found: doc_id, row, units, and first and last windows of
    runs, in the order of doc_id."""
    doc, row, at, cls = [], [], [], []
    for d, r, u, lo, hi in found:
        ok = hi + width <= len(u.values)
        own = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[ok].tolist(), hi[ok].tolist(), strict=True)] or [np.zeros(0, np.int64)]))
        doc.append(np.full(len(own), d))
        row.append(np.full(len(own), r))
        at.append(own)
        cls.append(digests(u, own, own, width))
    if sum(map(len, at)):
        doc, row, at, cls = map(np.concatenate, (doc, row, at, cls))
        yield from dealt(doc, row, at, at, mixed(cls[:, 0]), cls, n, first_stays, len(at))


def with_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """doc_id, row, text and runs (array) of every document, or (inner) of those that have any. Rows equal in doc_id and
    text share one list."""
    own = runs.groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi", "kind", "key", "source", "at")).alias("runs"))
    return docs.join(own, ["doc_id", "row"], how)


def run_arrays(column: pa.Array) -> list[dict[str, np.ndarray] | None]:
    """Each row's runs by lo; None where there are none."""
    out = []
    valid, offsets = column.is_valid().to_pylist(), column.offsets.to_numpy()
    names = [f.name for f in column.type.value_type]
    parts = [column.values.field(k).to_numpy() for k in range(len(names))]
    for k, ok in enumerate(valid):
        if ok:
            own = [p[offsets[k] : offsets[k + 1]] for p in parts]
            order = np.argsort(own[0], kind="stable")
            out.append({c: x[order] for c, x in zip(names, own, strict=True)})
        else:
            out.append(None)
    return out


def covered(n: int, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the runs."""
    edge = np.bincount(lo, minlength=n + 1) - np.bincount(hi + width, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def finished(docs: DataFrame, runs: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """`finish` (of batches with doc_id, text and runs) over all rows, those without a doc_id too, which have no runs."""
    rows = with_runs(keyed(docs), runs, "left").select("doc_id", "text", "runs")
    lost = id_text(docs).filter("doc_id is null").select("doc_id", "text", F.lit(None).cast(rows.schema["runs"].dataType).alias("runs"))
    return rows.mapInArrow(finish, schema).unionByName(lost.mapInArrow(finish, schema))
