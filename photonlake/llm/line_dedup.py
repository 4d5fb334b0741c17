"""Line dedup: lines that many documents share go, by a sharded minimal perfect hash.

A line's key is the line without white space (ASCII) at both ends, A-Z in lower case. The index has every distinct key of
the documents by its 128-bit digest, cut into shards of about KEYS keys. A shard is a minimal perfect hash (levels of bit
arrays; a key's place is the number of set bits before its own, about 3.7 bits a key) that leads into two compact arrays: a
32-bit fingerprint of the key and the number of documents that hold it. Documents probe those arrays: they send the
digests of their lines, packed into one row a slice of documents and shard, and get back the digests of those that go. No
line is sorted or joined, and no index is broadcast.

Counting is summed in each task before it is shuffled. A line that a third of all documents share is one probe a slice; the
documents that hold it are listed beside it, and a shard with many such entries is copied and probed in parts.

Every row is a document, also a repeated one. Null and empty texts have one empty line; empty keys are never dropped. Rows
are told apart by doc_id and a 64-bit hash of the text, and rows equal in both lose the same lines. An empty table gives
none. Documents other than the indexed ones can probe an index, too (`drop_lines` with `index`): a line that the index
doesn't have is then taken for one it has in about one of 2^32 cases, by its fingerprint."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import byte_texts, id_text, mixed, stored
from photonlake.llm.repeats import slices

IN_DOCUMENTS, LEAST_CHARS = 10, 1
KEYS = 1 << 18  # of a shard
ENTRIES = 1 << 20  # probes that a task looks up together
HELD_KEYS = 100_000
SHARD = "shard int, shards int, n long, sizes array<long>, bits binary, prints binary, counts binary, width int"
PROBE = "shard int, slice long, n long, doc binary, row binary, key binary, first binary"


def line_keys(data: bytes) -> list[bytes]:
    """The key of every line."""
    return [k.strip() for k in data.lower().split(b"\n")]


def long_enough(key: bytes, chars: int) -> bool:
    return len(key) >= chars and (len(key) >= 4 * chars or len(key.decode("utf-8", "replace")) >= chars)


def digests(keys: list[bytes]) -> np.ndarray:
    """128 bits of each key, as rows of two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys: each level gives a key a place among twice as many as there are keys;
    keys alone at their place stay there, the others go on to the next level."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.cumsum(bits) - bits

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (mixed(keys[:, 0] ^ mixed(keys[:, 1] + salt)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits = [], [np.zeros(0, np.int64)]
        while len(keys):
            size = max(64, 2 * len(keys))
            at = cls.place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone.astype(np.int64))
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(bits))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among all, a bijection for the keys it was built from; others get any place, or -1."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.place(keys[left], level, size)
            here = self.bits[at] == 1
            out[left[here]] = self.before[at[here]]
            left, base = left[~here], base + size
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys[:, 0] + mixed(keys[:, 1])) >> np.uint64(32)).astype(np.uint32)


def line_counts(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h0, h1 (the digest of a key) and n, the number of documents that hold it."""

    def packed(total: Counter[bytes]) -> pa.RecordBatch:
        keys = digests(list(total)).view(np.int64)
        return pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(total.values(), pa.int64())], ["h0", "h1", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in slices(batches):
            for data in byte_texts(batch):
                total.update(k for k in set(line_keys(data or b"")) if long_enough(k, least_chars))
            if len(total) > HELD_KEYS:
                yield packed(total)
                total = Counter()
        if total:
            yield packed(total)

    return id_text(docs).mapInArrow(count, "h0 long, h1 long, n long").groupBy("h0", "h1").agg(F.sum("n").alias("n"))


def line_index(docs: DataFrame, least_chars: int = LEAST_CHARS, keys_per_shard: int = KEYS) -> DataFrame:
    """The index of all keys of `docs`, one row a shard, as a stored table."""
    counts = stored(line_counts(docs, least_chars), "lines")
    shards = max(1, math.ceil(counts.count() / keys_per_shard))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("h0", "h1")], 1)
        found, n = PerfectHash.build(keys), table.column("n").to_numpy()
        slots = found.slots(keys)
        width = next(w for w in (1, 2, 4, 8) if int(n.max()) < 1 << 8 * w)
        prints, counts = np.zeros(len(keys), "<u4"), np.zeros(len(keys), f"<u{width}")
        prints[slots], counts[slots] = fingerprints(keys), n
        row = {"shard": [key[0].as_py()], "shards": [shards], "n": [len(keys)], "sizes": [found.sizes], "bits": [np.packbits(found.bits.astype(bool)).tobytes()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "width": [width]}
        return pa.table(row, pa.schema([("shard", pa.int32()), ("shards", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("prints", pa.binary()), ("counts", pa.binary()), ("width", pa.int32())]))

    return stored(counts.withColumn("shard", F.pmod("h0", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, SHARD), "line-index")


def probes(docs: DataFrame, shards: int, least_chars: int) -> DataFrame:
    """One row a slice of documents and shard: the distinct digests of its lines, and behind each of them (from `first` on) the
    documents that hold it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_numpy()
            holders: dict[bytes, list[int]] = {}
            for k, data in enumerate(byte_texts(batch)):
                for key in set(line_keys(data or b"")):
                    if long_enough(key, least_chars):
                        holders.setdefault(key, []).append(k)
            if not holders:
                continue
            key = digests(list(holders))
            doc = np.fromiter((k for own in holders.values() for k in own), np.int64)
            size = np.fromiter(map(len, holders.values()), np.int64, len(holders))
            begin = np.cumsum(size) - size
            shard = (key[:, 0].view(np.int64) % shards).astype(np.int64)
            order = np.lexsort((key[:, 1], key[:, 0], shard))
            cuts = np.r_[0, np.flatnonzero(np.diff(shard[order])) + 1, len(order)]
            name = xxhash.xxh3_64_intdigest(key[order].tobytes() + rows.tobytes()) >> 1
            missing = np.array([i is None for i in ids])
            number = np.array([i or 0 for i in ids], np.int64)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[a:b]
                docs_of = np.concatenate([doc[begin[k] : begin[k] + size[k]] for k in own])
                whose = np.stack([number[docs_of], missing[docs_of].astype(np.int64)], 1)
                out.append((int(shard[own[0]]), name, len(docs_of), whose.astype("<i8").tobytes(), rows[docs_of].astype("<i8").tobytes(), key[own].tobytes(), (np.cumsum(size[own]) - size[own]).astype("<i8").tobytes()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "slice", "n", "doc", "row", "key", "first"])

    return docs.mapInArrow(emit, PROBE)


def dropped_keys(docs: DataFrame, index: DataFrame, shards: int, in_documents: int, least_chars: int) -> DataFrame:
    """doc_id, row and `gone` (packed digests of the keys that go) of documents that lose lines, one row a shard at most."""
    sent = stored(probes(docs, shards, least_chars), "probes")
    parts = sent.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / ENTRIES)).cast("int").alias("parts"))
    index = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    sent = sent.join(parts, "shard").withColumn("part", F.pmod("slice", "parts").cast("int")).drop("parts")

    def meet(_: tuple[pa.Scalar, ...], sent: pa.Table, shard: pa.Table) -> pa.Table:
        own = {c: shard.column(c)[0].as_py() for c in ("n", "sizes", "bits", "prints", "counts", "width")}
        bits = np.unpackbits(np.frombuffer(own["bits"], np.uint8), count=sum(own["sizes"])).astype(np.int64)
        found, prints, counts = PerfectHash(own["sizes"], bits), np.frombuffer(own["prints"], "<u4"), np.frombuffer(own["counts"], f"<u{own['width']}")
        docs, rows, gone, none = [], [], [], []
        for at in range(sent.num_rows):
            whose, row, key, first = (sent.column(c)[at].as_py() for c in ("doc", "row", "key", "first"))
            key, first = np.frombuffer(key, "<u8").reshape(-1, 2), np.frombuffer(first, "<i8")
            slot = found.slots(key)
            known = slot >= 0
            known[known] = prints[slot[known]] == fingerprints(key[known])
            known[known] = counts[slot[known]] >= in_documents
            if not known.any():
                continue
            whose, row = np.frombuffer(whose, "<i8").reshape(-1, 2), np.frombuffer(row, "<i8")
            which = np.repeat(np.arange(len(key)), np.diff(np.r_[first, len(row)]))
            take = known[which]
            which, whose, row = which[take], whose[take], row[take]
            order = np.lexsort((which, row, whose[:, 0], whose[:, 1]))
            which, whose, row = which[order], whose[order], row[order]
            new = np.r_[True, (np.diff(whose, axis=0) != 0).any(1) | (np.diff(row) != 0)]
            cuts = np.r_[np.flatnonzero(new), len(row)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                docs.append(int(whose[a, 0]))
                none.append(bool(whose[a, 1]))
                rows.append(int(row[a]))
                gone.append(key[np.unique(which[a:b])].tobytes())
        return pa.table({"doc_id": pa.array([None if x else d for d, x in zip(docs, none, strict=True)], pa.int64()), "row": pa.array(rows, pa.int64()), "gone": pa.array(gone, pa.binary())})

    return sent.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInArrow(meet, "doc_id long, row long, gone binary")


def drop_lines(docs: DataFrame, in_documents: int = IN_DOCUMENTS, least_chars: int = LEAST_CHARS, index: DataFrame | None = None, keys_per_shard: int = KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text: the lines whose keys have at least `least_chars` code points and stand in at
    least `in_documents` documents are gone, the others joined by line breaks. index: a `line_index` of other documents
    that decides, made with the same `least_chars`."""
    index = line_index(docs, least_chars, keys_per_shard) if index is None else index
    head = index.select("shards").first()
    keyed = id_text(docs).select("doc_id", F.xxhash64("text").alias("row"), "text")
    if head is None:
        return keyed.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept_text"))
    gone = dropped_keys(keyed, index, head["shards"], in_documents, least_chars)
    gone = gone.groupBy("doc_id", "row").agg(F.collect_set("gone").alias("gone")).withColumnsRenamed({"doc_id": "_doc", "row": "_row"})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            total, lost, kept = [], [], []
            for data, own in zip(byte_texts(batch), batch.column("gone").to_pylist(), strict=True):
                lines = (data or b"").split(b"\n")
                total.append(len(lines))
                if own:
                    out = {part[k : k + 16] for part in own for k in range(0, len(part), 16)}
                    lines = [x for x, key in zip(lines, line_keys(data), strict=True) if xxhash.xxh3_128_digest(key) not in out]
                lost.append(total[-1] - len(lines))
                kept.append(b"\n".join(lines).decode("utf-8", "replace"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    both = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left").select("doc_id", "text", "gone")
    return both.mapInArrow(finish, "doc_id long, n_lines long, n_dropped long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    """The contract's columns from `drop_lines`."""
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
