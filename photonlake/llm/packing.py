"""Pattern packing: few-document length patterns whose repeat counts fit the length histogram.

Documents become token ids and an end id, cut into pieces of at most `capacity`. Only the histogram of piece lengths (at
most capacity rows) reaches the driver. There, patterns of up to three lengths (in units of `unit` tokens, rounded up)
that fill a sequence are enumerated, their repeat counts fitted to the histogram by non-negative least squares and
rounded; the repeats are realised with the true lengths, and what is left goes, longest first, to the tightest sequence
that still has room, or to a new one. The plan is a list of (lengths, repeats): its size follows the number of distinct
lengths, not of documents. Pieces then get a rank within their length, with a salt for every million of them, so that a length that a
third of all rows share is ranked by many tasks, and the rank gives the sequence and the place in it.

Null and empty texts are one piece that holds the end id alone. Repeated rows are packed each. An empty table gives no
rows. Very long texts give many pieces.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonlake.llm.common import held, id_text, slices, stored, texts, vocabulary_path

CAPACITY = 4096
END_ID = 1
PER_SALT = 1_000_000  # pieces of one length that a task ranks
UNIT = 32
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
LATIN = re.compile("[!-~\u00a1-\u017e]+")
#: The printable stand-ins of byte-level vocabularies for bytes that aren't printable Latin-1 characters.
STAND_INS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
WHOLE = re.compile("<\\|startoftext\\|>|<\\|endoftext\\|>|[\x1c-\x1f]")
CACHE_WORDS = 300_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Ids:
    """A text's ids as little-endian 32-bit bytes.

    Nothing that the tokenizer does looks across white space, so the ids of a run of other characters can be kept
    (within a bound); so can those of the words that its pattern splits a run into. Texts with
    special tokens, or with control characters that Python alone takes for white space, are encoded whole."""

    def __init__(self, path: str):
        self.tok, self.seen, self.words = tokenizer(path), {}, {}
        self.model = self.tok.model

    def _encode(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > CACHE_WORDS // 2:
                self.words.clear()
            seen = word if word.isascii() else word.encode().decode("latin-1").translate(STAND_INS)
            ids = [t.id for t in self.model.tokenize(seen)]
            found = self.words[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _run(self, run: str) -> bytes:
        """Splits a plain Latin run into words, whose ids are kept too; other runs are encoded as they stand."""
        if run.isascii() and run.isalpha():
            return self._word(run.lower())
        if LATIN.fullmatch(run):
            return b"".join([self._word(w) for w in WORDS.findall(unicodedata.normalize("NFC", run).lower())])
        return self._encode(run)

    def __call__(self, text: str) -> bytes:
        if WHOLE.search(text):
            return self._encode(text)
        seen, out = self.seen, []
        for run in text.split():
            ids = seen.get(run)
            if ids is None:
                if len(seen) > CACHE_WORDS:
                    seen.clear()
                ids = seen[run] = self._run(run)
            out.append(ids)
        return b"".join(out)


def ids_of(path: str) -> Ids:
    """One for each Python worker."""
    return held(path, lambda: Ids(path))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    path = path or vocabulary_path("word_bpe_49k.json")
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def run(batches):
        ids = ids_of(path)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                data = ids(text or "") + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, np.abs(b).max(initial=0)) * max(1, a.shape[0])
    for _ in range(3 * n):
        w = a.T @ (b - a @ x)
        w[free] = -np.inf
        k = int(w.argmax())
        if w[k] <= tol:
            break
        free[k] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                x = s
                break
            t = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = x + t * (s - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def patterns(units: int, most: int = 3) -> list[tuple[int, ...]]:
    """All non-increasing tuples of up to `most` unit lengths that sum to `units`."""
    out = [(units,)] if most >= 1 else []
    if most >= 2:
        out += [(units - b, b) for b in range(1, units // 2 + 1)]
    if most >= 3:
        out += [(a, b, units - a - b) for a, b in itertools.product(range(1, units), repeat=2) if a >= b >= units - a - b >= 1]
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up the histogram exactly; no pattern is longer than the capacity."""
    units = -(-capacity // unit)
    left = {k: v for k, v in histogram.items() if v}
    queue: dict[int, list[list[int]]] = defaultdict(list)  # by unit length: [length, count], longest first
    for length in sorted(left, reverse=True):
        queue[-(-length // unit)].append([length, left[length]])
    open_: list[list] = []  # lengths, repeats
    if left:
        have = np.zeros(units + 1)
        for u, q in queue.items():
            have[u] = sum(c for _, c in q)
        kinds = patterns(units)
        a = np.zeros((units + 1, len(kinds)))
        for k, kind in enumerate(kinds):
            for u in kind:
                a[u, k] += 1
        scale = np.sqrt(np.arange(units + 1) / units)  # long pieces are the harder to place
        for _ in range(8):  # what there isn't can't be packed: lengths asked for too often weigh more
            x = nnls(a * scale[:, None], have * scale)
            over = a @ x > 1.001 * have
            if not over.any():
                break
            scale[over] *= 3
        times = np.rint(x).astype(int)
        for k in sorted(times.nonzero()[0], key=lambda k: kinds[k], reverse=True):
            todo = int(times[k])
            while todo:
                need: dict[int, int] = defaultdict(int)
                for u in kinds[k]:
                    need[u] += 1
                if any(not queue[u] for u in need):
                    break
                # the front length of each unit, as often as every part lasts
                t = min(todo, *(queue[u][0][1] // m for u, m in need.items()))
                chosen = []
                if t:
                    for u, m in need.items():
                        chosen += [queue[u][0][0]] * m
                        queue[u][0][1] -= t * m
                else:  # one repeat over the border between two lengths
                    if any(sum(c for _, c in queue[u]) < m for u, m in need.items()):
                        break
                    t = 1
                    for u, m in need.items():
                        for _ in range(m):
                            chosen.append(queue[u][0][0])
                            queue[u][0][1] -= 1
                            if not queue[u][0][1]:
                                queue[u].pop(0)
                for u in need:
                    while queue[u] and not queue[u][0][1]:
                        queue[u].pop(0)
                open_.append([tuple(sorted(chosen, reverse=True)), t])
                todo -= t
    rooms: dict[int, list[list]] = defaultdict(list)
    for group in open_:
        rooms[capacity - sum(group[0])].append(group)
    sizes = sorted(rooms)

    def put(group: list) -> None:
        room = capacity - sum(group[0])
        if not rooms[room] and room not in sizes:
            insort(sizes, room)
        rooms[room].append(group)

    rest = sorted(((length, c) for q in queue.values() for length, c in q if c), reverse=True)
    for length, count in rest:
        while count:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                fit = capacity // length
                full, odd = divmod(count, fit)
                if full:
                    put([(length,) * fit, full])
                if odd:
                    put([(length,) * odd, 1])
                break
            room = sizes[at]
            group = rooms[room][-1]
            t = min(count, group[1])
            count -= t
            group[1] -= t
            if not group[1]:
                rooms[room].pop()
                if not rooms[room]:
                    sizes.pop(at)
            put([(*group[0], length), t])
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in rooms.values():
        for lengths, t in groups:
            merged[lengths] += t
    return sorted(merged.items(), reverse=True)


def slots(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, which of its ranks lie where: sorted by (length, first rank)."""
    rows, used, sequence = [], defaultdict(int), 0
    for lengths, times in made:
        at = 0
        for length in lengths:
            rows.append((length, used[length], sequence, at))
            used[length] += times
            at += length
        sequence += times
    out = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": out[:, 0], "rank": out[:, 1], "sequence": out[:, 2], "offset": out[:, 3]}


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, per_salt: int = PER_SALT) -> DataFrame:
    """All pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, path, capacity, end_id), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    salts = np.array([-(-histogram.get(k, 0) // per_salt) for k in range(capacity + 1)], np.int64)
    dealt = spark.createDataFrame([(k, int(salts[k])) for k in histogram], "length long, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")
    cut = cut.join(F.broadcast(dealt), "length").withColumn("salt", salt)
    cell = np.cumsum(salts) - salts  # of a length's first salt
    first = np.zeros(int(salts.sum()), np.int64)
    for r in cut.groupBy("length", "salt").agg(F.count("*").alias("n")).toLocalIterator():  # capacity + pieces / per_salt rows at most
        first[cell[r["length"]] + r["salt"]] = r["n"]
    first = np.cumsum(first) - first
    first -= np.repeat(first[cell[salts > 0]], salts[salts > 0])
    made = plan(histogram, capacity)
    shared = spark.sparkContext.broadcast((first, cell, slots(made)))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    wide = max(histogram.values(), default=0) + 1

    def place(batches):
        first, cell, s = shared.value
        keys = s["length"] * wide + s["rank"]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("r").to_numpy() - 1 + first[cell[length] + b.column("salt").to_numpy()]
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(s["sequence"][at] + rank - s["rank"][at]), pa.array(s["offset"][at])], [*kept, "sequence_id", "offset"])

    return cut.withColumn("r", F.row_number().over(order)).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
