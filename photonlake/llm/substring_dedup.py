"""Substring deduplication by relative Lempel-Ziv parsing, in words.

All documents together are the reference, cut into blocks (see `repeats`) that are indexed by their anchors, each with the
place where it stands first. A document is parsed against the index from left to right: a factor begins at a window that the
reference holds elsewhere and goes on greedily, window by window and block by block, as long as the same source goes on with
the same words; the next one, which may overlap it, begins at the first window that it doesn't hold. Every factor has `width` words at least. Where factors may end inside a block
(the index holds its anchor in other surroundings), each window at that boundary is looked up by the 128-bit digest of its
own words; blocks are compared by such digests too, never by their anchors alone. The words of factors are the duplicate
spans.

Words are maximal runs of bytes other than white space (ASCII). Every copy goes, the first too. Nulls and empty texts
have no words and lose none. Rows that share a doc_id are documents of their own, repeated rows are copies of each other.
Rows without a doc_id are returned as they are and take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import byte_texts, stored
from photonlake.llm.repeats import DECIDED, ENTRIES, PACKED, RUNS, Units, block_runs, covered, finished, keyed, merged, resolved, run_arrays, slices, window_entries, with_runs

WIDTH = 35
GRAM = 10
PER_BYTE = 0.014


def word_units(data: bytes) -> Units:
    words, digest = data.split(), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return Units(np.fromiter(map(digest, words), np.uint64, len(words)), b" ".join(words), end - size, end)


def boundary_runs(docs: DataFrame, runs: DataFrame, width: int) -> DataFrame:
    """RUNS of the windows of undecided blocks whose words stand elsewhere too."""
    open_ = runs.filter(f"kind <> {DECIDED}")
    n = max(8, (open_.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0) // ENTRIES)

    def emit(batches):
        for batch in slices(batches):
            order = np.argsort(batch.column("doc_id").to_numpy(), kind="stable").tolist()
            ids, rows, data, own = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), byte_texts(batch), run_arrays(batch.column("runs"))
            yield from window_entries([(ids[k], rows[k], word_units(data[k] or b""), own[k]["lo"], own[k]["hi"]) for k in order], width, n, False)

    def meet(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return resolved(table, False, 1)

    return with_runs(keyed(docs), open_, "inner").mapInArrow(emit, PACKED).groupBy("bucket").applyInArrow(meet, RUNS).filter(f"kind = {DECIDED}")


def duplicate_runs(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, per_byte: float = PER_BYTE, **limits) -> DataFrame:
    """RUNS of all windows (by first word) whose word sequence starts elsewhere too, with a source each."""
    runs = stored(block_runs(docs, word_units, width, gram, per_byte, False, **limits), "runs")
    return runs.filter(f"kind = {DECIDED}").unionByName(boundary_runs(docs, runs, width))


def parse(runs: dict[str, np.ndarray] | None, n: int, width: int) -> dict[str, np.ndarray]:
    """The factors of a document of n words: of the runs that begin at one window the longest counts; one that goes on in the
    same source extends the factor."""
    if runs is None:
        runs = dict.fromkeys(("lo", "hi", "source", "at"), np.zeros(0, np.int64))
    order = np.lexsort((-runs["hi"], runs["lo"]))
    lo, hi, source, at = (runs[c][order] for c in ("lo", "hi", "source", "at"))
    reach = np.r_[-1, np.maximum.accumulate(hi)[:-1]] if len(hi) else hi
    new = (hi > reach) & (hi + width <= n)  # what an earlier factor holds whole adds none
    own = {"doc_id": np.zeros(int(new.sum()), np.int64), "row": np.zeros(int(new.sum()), np.int64), "lo": lo[new], "hi": hi[new], "source": source[new], "at": at[new]}
    return merged(own)


def factors(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """doc_id, start and n_words of every factor, source_id (another document's, or the own one) and source_start."""

    def finish(batches):
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), []
            for data, runs in zip(byte_texts(batch), run_arrays(batch.column("runs")), strict=True):
                found.append(parse(runs, len((data or b"").split()), width))
            cols = [np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in ("lo", "hi", "source", "at")]
            doc = [d for d, f in zip(ids, found, strict=True) for _ in f["lo"]]
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(cols[0]), pa.array(cols[1] - cols[0] + width), pa.array(cols[2]), pa.array(cols[3])], ["doc_id", "start", "n_words", "source_id", "source_start"])

    return finished(docs, duplicate_runs(docs, width, **limits), finish, "doc_id long, start long, n_words long, source_id long, source_start long")


def deduplicated(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text: the words that stay, joined by one space."""
    return _finish(docs, width, lambda kept: pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()), "kept_text string", **limits)


def digest(docs: DataFrame, width: int = WIDTH, **limits) -> DataFrame:
    """The contract's columns."""
    return _finish(docs, width, lambda kept: pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), "kept_sha256 string", **limits)


def _finish(docs: DataFrame, width: int, form, column: str, **limits) -> DataFrame:
    name = column.split()[0]

    def finish(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for data, runs in zip(byte_texts(batch), run_arrays(batch.column("runs")), strict=True):
                words = (data or b"").split()
                found = parse(runs, len(words), width)
                mark = covered(len(words), found["lo"], found["hi"], width)
                total.append(len(words))
                gone.append(int(mark.sum()))
                kept.append(b" ".join([w for w, m in zip(words, mark.tolist(), strict=True) if not m] if gone[-1] else words))
            yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), form(kept)], ["doc_id", "n_words", "n_removed", name])

    return finished(docs, duplicate_runs(docs, width, **limits), finish, f"doc_id long, n_words long, n_removed long, {column}")
