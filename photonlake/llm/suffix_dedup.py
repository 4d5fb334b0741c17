"""Byte deduplication by difference-cover suffix arrays.

Suffixes matter only where a string of `width` bytes can repeat, and a suffix array of all bytes would be many times the
input (README has figures). So blocks (see `repeats`) first settle what repeats as a whole, by 128-bit digests of their
bytes; what stays open is text around the ends of repeats. Its stretches are shuffled by anchor, so that all suffixes that
can share `width` bytes meet in one bucket, and each bucket sorts its suffixes by the difference cover modulo 3: triples at
positions 1 and 2 modulo 3 are sorted and named, the names sorted by recursion, the suffixes at 0 modulo 3 merged in by
their first byte and the rank behind it. Suffixes that agree in `width` bytes are then neighbours; adjacent prefixes are
compared byte by byte, and all members of a class but the first (by doc_id, then start) are repeats. Windows of anchors that
stand in too many surroundings for one bucket are compared by their own 128-bit digests, spread over all buckets.

Texts are UTF-8; nulls are empty. Matches never cross documents. Strings are judged on the input. Rows that share a doc_id
are one document of several texts: of two equal strings the later start goes, and of equal starts neither. Rows without a
doc_id are returned as they are and take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import byte_texts, stored
from photonlake.llm.repeats import DECIDED, FIELDS, OPEN, PACKED, RUNS, Units, WIDE, block_runs, covered, finished, from_planes, keyed, merged, packed, resolved, run_arrays, slices, window_entries, with_runs

WIDTH = 100
GRAM = 32
PER_BYTE = 0.029
BUCKET_BYTES = 750_000
_BYTE = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def byte_units(data: bytes) -> Units:
    at = np.arange(len(data) + 1)
    return Units(_BYTE[np.frombuffer(data, np.uint8)], data, at[:-1], at[1:])


def _joined(*columns: np.ndarray) -> np.ndarray:
    """One integer for each row of some integer columns, in the rows' order; ranks stand in where 63 bits don't do."""
    out = columns[0].astype(np.int64)
    for c in columns[1:]:
        wide = int(c.max(initial=0)) + 1
        if (int(out.max(initial=0)) + 1) * wide >= 1 << 63:
            out = np.unique(out, return_inverse=True)[1]
        out = out * wide + c
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a sequence of positive integers, by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.r_[s.astype(np.int64), 0, 0, 0]
    first, second = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a dummy triple ends the first row if n = 1 mod 3
    cover = np.r_[first, second]
    triple = _joined(t[cover], t[cover + 1], t[cover + 2])
    order = np.argsort(triple)
    new = np.r_[1, triple[order][1:] != triple[order][:-1]]
    if not new.all():
        name = np.empty(len(cover), np.int64)
        name[order] = np.cumsum(new)
        order = suffix_array(name)
    rank = np.zeros(n + 3, np.int64)
    rank[cover[order]] = np.arange(1, len(cover) + 1)
    sampled = cover[order]
    sampled = sampled[sampled < n]
    # the rest, by first symbol and the rank behind it; then where they fall among the sampled ones
    wide = int(rank.max()) + 1
    rest = np.arange(0, n, 3)
    low = t[rest] * wide + rank[rest + 1]
    order = np.argsort(low)
    rest, low = rest[order], low[order]
    one = sampled[sampled % 3 == 1]
    two = sampled[sampled % 3 == 2]
    below = np.searchsorted(t[one] * wide + rank[one + 1], low)
    both = np.r_[two, rest]
    key = _joined(t[both], t[both + 1], rank[both + 2])
    below = below + np.searchsorted(key[: len(two)], key[len(two) :])
    out = np.empty(n, np.int64)
    place = below + np.arange(len(rest))
    free = np.ones(n, bool)
    free[place] = False
    out[place] = rest
    out[free] = sampled
    return out


def open_repeats(doc: np.ndarray, row: np.ndarray, lo: np.ndarray, size: np.ndarray, text: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """Runs of the windows of some stretches that repeat an earlier one. text: all stretches, one after another."""
    begin = np.cumsum(size) - size
    gap = np.ones(len(text) + len(size), np.int64)  # each stretch is followed by a 1, its bytes are 2 and up
    gap[np.arange(len(text)) + np.repeat(np.arange(len(size)), size)] = text.astype(np.int64) + 2
    order = suffix_array(gap)
    stretch = np.repeat(np.arange(len(size)), size + 1)[order]
    inside = order - (begin + np.arange(len(size)))[stretch]
    keep = inside + width <= size[stretch]
    order, stretch, inside = order[keep], stretch[keep], inside[keep]
    same = np.zeros(len(order), bool)
    step = max(1, (1 << 24) // width)
    for k in range(1, len(order), step):
        a, b = order[k - 1 : k - 1 + step], order[k : k + step]
        a = a[: len(b)]
        ok = np.ones(len(b), bool)
        for j in range(width):  # compared byte by byte, as long as they agree
            live = ok.nonzero()[0]
            if not len(live):
                break
            ok[live] = gap[a[live] + j] == gap[b[live] + j]
        same[k : k + len(b)] = ok
    cls = np.cumsum(~same)
    d, r, at = doc[stretch], row[stretch], lo[stretch] + inside
    by = np.lexsort((at, d, cls))
    cls, d, r, at = cls[by], d[by], r[by], at[by]
    start = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, np.int64)
    head = np.repeat(start, np.diff(np.r_[start, len(cls)]))
    later = (d != d[head]) | (at != at[head])
    return merged({"doc_id": d[later], "row": r[later], "lo": at[later], "hi": at[later], "source": d[head[later]], "at": at[head[later]]})


STRETCH = 3  # the part number of packed stretches, beside those of single windows
PACKED_OPEN = PACKED + ", body binary"


def boundary_runs(docs: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """RUNS of the windows of undecided blocks that repeat an earlier one: OPEN blocks as stretches of text, by anchor, WIDE
    ones window by window."""
    open_ = runs.filter(f"kind <> {DECIDED}")
    n = max(8, (open_.agg(F.sum(F.col("hi") - F.col("lo") + width)).first()[0] or 0) // BUCKET_BYTES)

    def emit(batches):
        for batch in slices(batches):
            order = np.argsort(batch.column("doc_id").to_numpy(), kind="stable").tolist()
            ids, rows, data, own = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), byte_texts(batch), run_arrays(batch.column("runs"))
            doc, row, lo, size, key, parts, wide = [], [], [], [], [], [], []
            for k in order:
                text, r = data[k] or b"", own[k]
                ok = r["hi"] + width <= len(text)
                some = ok & (r["kind"] == WIDE)
                if some.any():
                    wide.append((ids[k], rows[k], byte_units(text), r["lo"][some], r["hi"][some]))
                for a, b, c in zip(*(r[c][ok & ~some].tolist() for c in ("lo", "hi", "key")), strict=True):
                    doc.append(ids[k])
                    row.append(rows[k])
                    lo.append(a)
                    size.append(b + width - a)
                    key.append(c)
                    parts.append(text[a : b + width])
            for rest in window_entries(wide, width, n, True):
                yield rest.append_column("body", pa.nulls(rest.num_rows, pa.binary()))
            if doc:
                bucket = (np.array(key, np.int64).view(np.uint64) % np.uint64(n)).astype(np.int64)
                columns = {"doc": np.array(doc, "<i8"), "row": np.array(row, "<i8"), "lo": np.array(lo, "<i4"), "n": np.array(size, "<i4")}
                by = np.argsort(bucket, kind="stable")
                groups = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)
                yield packed(bucket, columns, STRETCH).append_column("body", pa.array([b"".join([parts[i] for i in g]) for g in groups], pa.binary()))

    def sort(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = resolved(table.drop_columns(["body"]), True, 1)
        own = table.filter(pc.equal(table.column("part"), STRETCH))
        if own.num_rows:
            doc, row, lo, size = (np.concatenate([from_planes(x, kind) for x in own.column(c).to_pylist()]).astype(np.int64) for c, kind in (("doc", "<i8"), ("row", "<i8"), ("lo", "<i4"), ("n", "<i4")))
            found = open_repeats(doc, row, lo, size, np.frombuffer(b"".join(own.column("body").to_pylist()), np.uint8), width)
            none = np.zeros(len(found["lo"]), np.int64)
            found |= {"kind": (none + DECIDED).astype(np.int32), "key": none}
            out = pa.concat_tables([out, pa.table([pa.array(found[c]) for c in FIELDS], FIELDS)])
        return out

    return with_runs(keyed(docs), open_, "inner").mapInArrow(emit, PACKED_OPEN).groupBy("bucket").applyInArrow(sort, RUNS).filter(f"kind = {DECIDED}")


def duplicate_runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, per_byte: float = PER_BYTE, **limits) -> DataFrame:
    """RUNS of all windows (by first byte) that also start earlier."""
    runs = stored(block_runs(docs, byte_units, width, gram, per_byte, True, **limits), "runs")
    return runs.filter(f"kind = {DECIDED}").unionByName(boundary_runs(docs, runs, width))


def deduplicated(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay)."""
    return _finish(docs, width, lambda kept: pa.array(kept, pa.binary()), "kept binary", **limits)


def digest(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """The contract's columns."""
    return _finish(docs, width, lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept_sha256 string", **limits)


def _finish(docs: DataFrame, width: int, form, column: str, **limits) -> DataFrame:
    name = column.split()[0]

    def finish(batches):
        for batch in batches:
            sizes, gone, runs_, kept = [], [], [], []
            for data, runs in zip(byte_texts(batch), run_arrays(batch.column("runs")), strict=True):
                data = data or b""
                sizes.append(len(data))
                if runs is None:
                    gone.append(0)
                    runs_.append(0)
                    kept.append(data)
                    continue
                mark = covered(len(data), runs["lo"], runs["hi"], width)
                gone.append(int(mark.sum()))
                runs_.append(int(np.count_nonzero(mark & ~np.r_[False, mark[:-1]])))
                kept.append(np.frombuffer(data, np.uint8)[~mark].tobytes())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs_)), form(kept)], ["doc_id", "n_bytes", "n_removed", "n_spans", name])

    return finished(docs, duplicate_runs(docs, width, **limits), finish, f"doc_id long, n_bytes long, n_removed long, n_spans long, {column}")
