"""Periodic runs: stretches of words that repeat with a period, by multi-scale minimizers.

A run is a stretch of a document's words with smallest period q (words q apart are the same) and at least
max(`least`, `copies` * q) words that no neighbouring word extends. Scale w = 4, 8, 16, ... looks for periods of 2w to
4w - 1: of every w consecutive w-grams the one with the least hash is a minimizer (all equal ones are). Inside a run that
choice repeats at the distance of the period, so a run holds two minimizers with one w-gram just q apart. Such pairs seed
the runs; a seed is extended both ways by hashes of 2^k-grams.

Equal minimizers at most w / 3 apart lie in a run of a shorter period, which another scale finds; of a chain of them only the
first is paired. A run whose every minimizer is in a chain would have the chain's period, so none is lost, and a minimizer
meets at most 12 equal ones within 4w. Periods below 8 are too short for minimizers and are looked for by comparing words
1 to 7 apart. A stretch found with a multiple of its period is found with the period, too, at the same ends: the shortest
counts. Found runs are compared word by word; a hash that took different words for equal leads to a plain search over the
document.

Documents are cut and searched in the task that reads them; nothing is shuffled. Null and empty texts have no words and
no runs; repeated rows have the same runs; very long texts are read whole (a task holds about 8 MB of text, or one longer
document)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import byte_texts, id_text, mixed
from photonlake.llm.repeats import slices

LEAST, COPIES = 6, 4
SHORT = 7  # the longest period that is looked for by comparing words
WORDS = 1 << 18  # searched together
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def sliding(a: np.ndarray, w: int, pick: np.ufunc) -> np.ndarray:
    """pick over a[i : i + w], for w a power of two."""
    step = 1
    while step < w:
        a = pick(a[:-step], a[step:])
        step *= 2
    return a


def gram_levels(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the 2^k-grams at every place, up to a quarter of `longest`."""
    out = [mixed(x.astype(np.uint64) + np.uint64(1))]
    while (2 << len(out)) <= max(4, longest // 4):
        a, w = out[-1], 1 << (len(out) - 1)
        out.append(mixed(a[:-w] * np.uint64(0x9E3779B97F4A7C15) ^ a[w:]))
    return out


def seeds(g: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal minimizers 2w to 4w - 1 apart, from the hashes of w-grams."""
    none = np.zeros(0, np.int64)
    if len(g) < w:
        return none, none
    least = sliding(g, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), w, np.maximum) == g)
    key = g[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    chained = np.r_[False, (key[1:] == key[:-1]) & (at[1:] - at[:-1] <= w // 3)]
    at, key = at[~chained], key[~chained]
    first, second, back = [none], [none], 1
    while back < len(at):
        near = np.flatnonzero((key[back:] == key[:-back]) & (at[back:] - at[:-back] < 4 * w))
        if not len(near):
            break
        far = near[at[near + back] - at[near] >= 2 * w]
        first.append(at[far])
        second.append(at[far + back])
        back += 1
    return np.concatenate(first), np.concatenate(second)


def extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, forwards: bool) -> np.ndarray:
    """How many words from a and b on (or before a and b) are the same; a < b."""
    n, size = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        g, w = levels[k], 1 << k
        going = np.arange(len(a))
        while len(going):
            p = a[going] + size[going] if forwards else a[going] - size[going] - w
            q = p + (b - a)[going]
            inside = q + w <= n if forwards else p >= 0
            going, p, q = going[inside], p[inside], q[inside]
            going = going[g[p] == g[q]]
            size[going] += w
            if k + 1 < len(levels):
                break  # a longer gram differs, so one step at most
    return size


def lag_runs(x: np.ndarray, q: int, need: int) -> list[tuple[int, int, int]]:
    """Stretches of at least `need` words whose words q apart are the same, as (start, end, q)."""
    if len(x) <= q:
        return []
    turn = np.flatnonzero(np.diff(np.concatenate([[False], x[q:] == x[:-q], [False]]).astype(np.int8)))
    start, end = turn[::2], turn[1::2] + q
    long = end - start >= need
    return [(s, e, q) for s, e in zip(start[long].tolist(), end[long].tolist(), strict=True)]


def find_runs(x: np.ndarray, longest: int, least: int = LEAST, copies: int = COPIES) -> list[tuple[int, int, int]]:
    """All runs of a sequence of numbers as (start, end, period) by start and period; `longest` bounds their length. Numbers
    that stand once only part documents. copies is 4 at least, which seeds need."""
    if copies < 4:
        raise ValueError("runs are seeded by four copies or more")
    need = lambda q: np.maximum(least, copies * q)
    found = [r for q in range(1, min(SHORT, longest // copies) + 1) for r in lag_runs(x, q, int(need(q)))]
    if longest >= copies * (SHORT + 1):
        levels = gram_levels(x, longest)
        for k in range(2, len(levels)):
            a, b = seeds(levels[k], 1 << k)
            if not len(a):
                continue
            q = b - a
            start, end = a - extend(levels, a, b, False), b + extend(levels, a, b, True)
            long = end - start >= need(q)
            for s, e, p in np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0).tolist():
                exact = np.array_equal(x[s : e - p], x[s + p : e]) and (s == 0 or x[s - 1] != x[s - 1 + p]) and (e == len(x) or x[e] != x[e - p])
                found += [(s, e, p)] if exact else lag_runs(x, p, int(need(p)))
    shortest: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        shortest[s, e] = min(q, shortest.get((s, e), q))
    return sorted((s, e, q) for (s, e), q in shortest.items())


def runs_of_documents(words: list[list[bytes]], least: int = LEAST, copies: int = COPIES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, which are searched together: documents of like lengths are put
    one behind the other, parted by numbers that stand once only."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    order = sorted((k for k in range(len(words)) if len(words[k]) >= least), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        to, size = at, 0
        while to < len(order) and (to == at or size + len(words[order[to]]) <= WORDS):
            size += len(words[order[to]])
            to += 1
        group = order[at:to]
        ids = pa.array([w for k in group for w in words[k]], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        ends = np.cumsum([len(words[k]) for k in group])
        x = np.insert(ids, ends[:-1], ids.max(initial=0) + 1 + np.arange(len(group) - 1))
        begin = np.r_[0, ends[:-1] + np.arange(1, len(group))]
        for s, e, q in find_runs(x, len(words[group[-1]]), least, copies):
            k = int(np.searchsorted(begin, s, "right")) - 1
            out[group[k]].append((s - int(begin[k]), e - s, q))
        at = to
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        step[s + q] += 1
        step[s + n] -= 1
    gone = np.cumsum(step[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """doc_id, n_words, runs (by start and period) and `collapsed`, the words that stay when each run keeps its first period
    (those in no run and those in the first period of every run that holds them), joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [(t or b"").split() for t in byte_texts(batch)]
            found = runs_of_documents(words, least, copies)
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in own] for own in found]
            text = [b" ".join(kept_words(w, r)).decode("utf-8", "replace") for w, r in zip(words, found, strict=True)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(map(len, words)), pa.int64()), pa.array(rows, _RUN), pa.array(text, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs).mapInArrow(run, RUNS)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text in which about every tenth document, by a hash of its id, goes on periodically from some word on; the
    others, and rows without an id, stay."""
    df = id_text(docs)
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))
    chosen = df.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10)})
    chosen = chosen.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", place(i).cast("int"))), " ")
    return chosen.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digest(runs: DataFrame) -> DataFrame:
    """The contract's columns from `periodic_runs`."""
    first = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    df = runs.withColumn("_f", first)
    length, period = -F.col("_f.a"), F.col("_f.period")
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_f.start").alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
