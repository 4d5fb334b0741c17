"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and items are folded to one symbol a character: letters and digits in lower case, every run of anything else as
one gap. A document's windows have an item's length. An item that may have k edits is cut into k + 1 pieces, one of which
stands unedited in every match (pigeonhole bound), so every place of a piece in a document gives a window; windows whose
neighbouring pieces rule out a match are dropped before the embedding, by the same bound, so none is lost here. The CGK
random walk reads a string with random pauses, so that two strings at a small edit distance give sequences at a small
Hamming distance; `WALKS` walks are tried, since one may drift. Of each sequence, samples of `BITS` positions are compared;
their number follows from the recall wanted for windows at the largest distance. What collides is verified: the edit
distance of the item to the best part of the document around the window must be at most (1 - similarity) of the item's
length.

The items' texts are broadcast in groups whose search tables take at most GROUP_BYTES in a task, one pass over the documents
each and one group at a time; tasks build the tables. Of an item's sequences only the sampled positions are kept, and
positions once a length. No document is shuffled to be judged. Symbols are compared
as they are; one byte of each is enough to search by. Null and empty texts match nothing. Items so short that no edit is allowed (under 10 symbols at 0.9)
are found where they stand as whole words. Repeated rows are reported each, as are repeated item_ids and items that
are equal after folding. Empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import held, id_text, kept_rows, stored, texts, unused

SIMILARITY = 0.9
RECALL = 0.95
SEED_LENGTH = 9
#: Pieces that are compared together around a seed, step by step.
GROUPS = (2, 4, 8)
BITS = 4
WALKS = 3
#: Share of equal positions of two embedded strings at the largest distance, as measured (see tests).
AGREEMENT = 0.42
SEEDS = 1 << 16
#: Bytes of a group of items in a task: about ITEM_BYTES an item (its samples of all walks) and SYMBOL_BYTES a symbol.
GROUP_BYTES = 128 << 20
ITEM_BYTES, SYMBOL_BYTES = 1_500, 40
CHUNK = 1 << 21
#: Bytes of embedded sequences at a time.
SEQUENCES = 1 << 25
CACHED = 1 << 15
WINDOWS = STEPS = 1 << 13
PAD = 255


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its symbol (letters and digits in lower case, 0 for the rest), and that in one byte."""
    wide = np.zeros(0x110000, np.uint32)
    for c in map(chr, range(len(wide))):
        if c.isalnum():
            wide[ord(c)] = ord(c.lower()[0])
    return wide, np.where(wide < 254, wide, 1 + wide % 253).astype(np.uint8)


def fold(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, and the same in one byte each: 0 is a gap, of which there is none at the ends and never two in a row. The
    bytes are searched, since equal symbols have equal bytes; what is found is verified in symbols."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    wide, byte = (t[points] for t in _fold_tables())
    keep = (byte > 0) | np.r_[False, byte[:-1] > 0] if len(byte) else np.zeros(0, bool)
    wide, byte = wide[keep], byte[keep]
    end = len(byte) - 1 if len(byte) and byte[-1] == 0 else len(byte)
    return wide[:end], byte[:end]


def keys(buffer: np.ndarray, at: int, n: int, size: int) -> np.ndarray:
    """64-bit keys of the n grams of `size` (at most SEED_LENGTH) symbols that begin at buffer[at:]; equal grams have equal
    keys. `buffer` must go on for 8 behind the last."""
    key = np.ndarray((max(0, n),), "<u8", buffer, at, (1,)).copy()
    if size < 8:
        key &= np.uint64((1 << 8 * size) - 1)
    key *= np.uint64(0x9E3779B97F4A7C15)
    if size > 8:
        key += buffer[at + 8 : at + 8 + len(key)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return key


def extended(text: np.ndarray, at: np.ndarray, pattern: np.ndarray, by: np.ndarray, length: np.ndarray, step: int, most: int) -> np.ndarray:
    """The edits between `length` symbols of `pattern` from `by` on and the text from `at` on, which may end anywhere; both
    are read in direction `step`. Exact up to `most`, over that some larger number."""
    order = np.argsort(-length, kind="stable")
    at, by, length = at[order], by[order], length[order]
    cost = np.full((2 * most + 1, len(at)), most + 1, np.int16)  # by diagonal: text minus pattern, from -most on
    cost[most:] = np.arange(most + 1)[:, None]
    live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")  # with length > i
    for i, n in enumerate(live.tolist()):
        symbol, from_, old = pattern[by[:n] + step * i], at[:n] + step * (i - most), cost[:, :n]
        for d in range(2 * most + 1):
            new = old[d] + (text[from_ + step * d] != symbol) if i + d >= most else np.full(n, most + 1, np.int16)
            if d < 2 * most:
                np.minimum(new, old[d + 1] + 1, out=new)
            if d:
                np.minimum(new, old[d - 1] + 1, out=new)
            old[d] = new
    out = np.empty(len(at), np.int16)
    out[order] = cost.min(0)
    return out


def walk_bits(steps: int, seed: int = 17) -> np.ndarray:
    """Whether the walk moves on at a step and symbol."""
    return np.random.default_rng(seed).integers(0, 2, (steps, 256), np.uint8)


def embed(flat: np.ndarray, start: np.ndarray, length: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The CGK sequences (steps x windows, 2 * length steps each) of the windows that begin at flat[start]. `length` must
    not increase; `flat` must go on for 2 * length behind every start."""
    out = np.full((2 * int(length.max(initial=0)), len(start)), PAD, np.uint8)
    at = start.astype(np.int64)
    live = np.searchsorted(-length, -np.arange(len(out)) // 2, "left")  # windows with 2 * length > step
    for step, n in enumerate(live.tolist()):
        symbol = flat[at[:n]]
        out[step, :n] = symbol
        at[:n] += moves[step][symbol]
    return out


def embedded_samples(flat: np.ndarray, start: np.ndarray, length: np.ndarray, moves: np.ndarray, steps: np.ndarray, most: int) -> np.ndarray:
    """What the sequences hold at `steps` (windows x tables x BITS); at most about `most` bytes of sequences at a time."""
    out = np.empty(steps.shape, np.uint8)
    order = np.argsort(-length, kind="stable")
    at = 0
    while at < len(order):
        part = order[at : at + max(1, most // max(1, 2 * int(length[order[at]])))]
        code = embed(flat, start[part], length[part], moves)
        out[part] = code[steps[part], np.arange(len(part))[:, None, None]]
        at += len(part)
    return out


def sampled_steps(length: int, tables: int, seed: int = 23) -> np.ndarray:
    """tables x BITS of the 2 * length steps, in which the walk on average reads the whole string."""
    return np.random.default_rng(seed + length).integers(0, 2 * length, (tables, BITS), np.int32)


def tables_for(recall: float, agreement: float = AGREEMENT, bits: int = BITS) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreement**bits)))


def best_distance(item: Sequence[int], region: Sequence[int]) -> tuple[int, int]:
    """(distance, end) of the part of `region` nearest to `item`, by bit-parallel dynamic programming."""
    m = len(item)
    if not m:
        return 0, 0
    peq: dict[int, int] = {}
    for k, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(region):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """A group of items, ready to be looked for."""

    def __init__(self, ids: list[int], folded: list[tuple[np.ndarray, np.ndarray]], similarity: float, recall: float):
        self.ids, self.folded, arrays = ids, [f[0].tolist() for f in folded], [f[1] for f in folded]
        self.lengths = np.array([len(x) for x in arrays])
        self.most = np.array([int((1 - similarity) * n + 1e-9) for n in self.lengths.tolist()])
        tables = tables_for(recall)  # for each walk, since walks drift together
        self.longest = int(self.lengths.max(initial=1))
        self.moves = [walk_bits(2 * self.longest, seed) for seed in range(WALKS)]
        known, self.kind = np.unique(self.lengths, return_inverse=True)
        self.steps = np.stack([sampled_steps(n, tables) for n in known.tolist()])  # of each length
        flat = np.concatenate([x for own in arrays for x in (own, np.full(2 * len(own), PAD, np.uint8))])
        start = 3 * (np.cumsum(self.lengths) - self.lengths)
        self.codes = [np.empty((len(arrays), tables, BITS), np.uint8) for _ in self.moves]
        for k in range(0, len(arrays), STEPS):
            own = slice(k, k + STEPS)
            for moves, codes in zip(self.moves, self.codes, strict=True):
                codes[own] = embedded_samples(flat, start[own], self.lengths[own], moves, self.steps[self.kind[own]], SEQUENCES)
        # edits + 1 pieces of each item: one of them stands unedited in every match
        self.flat = np.concatenate([*arrays, np.full(16, PAD, np.uint8)])
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.cuts = np.concatenate([np.arange(k + 2) * n // (k + 1) for n, k in zip(self.lengths.tolist(), self.most.tolist(), strict=True)])
        self.cut_at = np.cumsum(self.most + 2) - (self.most + 2)
        self.seed = np.minimum(self.lengths // (self.most + 1), SEED_LENGTH)
        self.tables = {}
        for size in np.unique(self.seed).tolist():
            own = (self.seed == size).nonzero()[0]
            item = np.repeat(own, self.most[own] + 1)
            number = np.concatenate([np.arange(k + 1) for k in self.most[own].tolist()])
            key = np.concatenate([keys(self.flat, at, 1, size) for at in (self.begin[item] + self.cuts[self.cut_at[item] + number]).tolist()])
            order = np.argsort(key, kind="stable")
            bits = min(26, max(14, 6 + len(key).bit_length()))
            known = np.zeros(1 << bits, bool)
            known[key >> np.uint64(64 - bits)] = True
            self.tables[size] = (known, np.uint64(64 - bits), key[order], item[order], number[order])

    def closer(self, text: np.ndarray, at: np.ndarray, item: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which seeds (piece `number` of `item` stands at text[at]) can belong to a match. A group of t neighbouring
        pieces that has t or more edits isn't the one that the pigeonhole bound promises; then neither are its pieces."""
        left = np.arange(len(at))
        offset = self.cuts[self.cut_at[item] + number]
        for group in GROUPS:
            i, a = item[left], at[left]
            low = number[left] // group * group
            high = np.minimum(low + group, self.most[i] + 1)
            before = offset[left] - self.cuts[self.cut_at[i] + low]
            behind = self.cuts[self.cut_at[i] + high] - offset[left] - self.seed[i]
            by, most = self.begin[i] + offset[left], int((high - low).max(initial=1)) - 1
            edits = extended(text, a - 1, self.flat, by - 1, before, -1, most) + extended(text, a + self.seed[i], self.flat, by + self.seed[i], behind, 1, most)
            left = left[edits < high - low]
        i, a = item[left], at[left]
        whole = (self.most[i] > 0) | np.isin(text[a - 1], (0, PAD)) & np.isin(text[a + self.lengths[i]], (0, PAD))
        return left[whole]

    def windows(self, text: np.ndarray, margin: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, start) of the windows of `text` that may hold an item; text[margin:-margin] are documents."""
        found = []
        for size, (known, shift, gram, items, numbers) in self.tables.items():
            hits, waiting = [], 0
            for k in range(margin, len(text) - margin, CACHED):  # short arrays stay in the processor's cache
                key = keys(text, k, min(CACHED, len(text) - margin - k), size)
                hit = known[key >> shift].nonzero()[0]
                low, high = (np.searchsorted(gram, key[hit], side) for side in ("left", "right"))
                hits.append(np.stack([hit + k, low, high - low])[:, high > low])
                waiting += int((high - low).sum())
                if waiting < SEEDS and k + CACHED < len(text) - margin:
                    continue
                at, low, n = np.concatenate(hits, 1)
                hits, waiting = [], 0
                for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // SEEDS)) + 1):
                    own = n[cut]
                    entry = np.repeat(low[cut] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                    where, item, number = np.repeat(at[cut], own), items[entry], numbers[entry]
                    good = self.closer(text, where, item, number)
                    where, item, number = where[good], item[good], number[good]
                    found.append(np.stack([item, np.searchsorted(first, where, "right") - 1, where - self.cuts[self.cut_at[item] + number]]))
        return tuple(np.unique(np.concatenate(found or [np.zeros((3, 0), np.int64)], 1), axis=1))

    def matches(self, flat: np.ndarray, wide: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document position, item, distance, end) of the matches in `flat` (bytes) and `wide` (symbols), documents one
        after another; first: where each begins."""
        margin = 2 * self.longest + 16
        text = np.r_[np.full(margin, PAD, np.uint8), flat, np.full(margin, PAD, np.uint8)]
        item, document, start = self.windows(text, margin, first + margin)
        near = self.most[item] == 0
        for k in range(0, len(item), WINDOWS):
            own = item[k : k + WINDOWS]
            for moves, codes in zip(self.moves, self.codes, strict=True):
                code = embedded_samples(text, start[k : k + WINDOWS], self.lengths[own], moves, self.steps[self.kind[own]], SEQUENCES)
                near[k : k + WINDOWS] |= (code == codes[own]).all(2).any(1)
        item, document, start = item[near], document[near], start[near] - margin
        last = np.r_[first[1:], len(flat)]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        # starts whose regions overlap are looked at once
        new = np.flatnonzero(np.r_[True, (np.diff(item) != 0) | (np.diff(document) != 0) | (np.diff(start) > self.lengths[item[1:]])]) if len(item) else np.zeros(0, int)
        for k, e in zip(new.tolist(), np.r_[new, len(item)][1:].tolist(), strict=True):
            i, d = int(item[k]), int(document[k])
            length, slack = int(self.lengths[i]), int(self.most[i])
            a, b = max(int(first[d]), int(start[k]) - slack), min(int(last[d]), int(start[e - 1]) + length + slack)
            distance, end = best_distance(self.folded[i], wide[a:b].tolist())
            if distance <= slack and (distance, a + end) < best.get((d, i), (slack + 1, 0)):
                best[d, i] = (distance, a + end)
        return [(d, i, distance, end - int(first[d])) for (d, i), (distance, end) in best.items()]


def item_groups(items: DataFrame, bound: int = GROUP_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the items in groups of at most about `bound` bytes of search tables, read in a stream: the driver holds the
    texts of one group at a time."""
    ids, held, size = [], [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").toLocalIterator():
        if not any(map(str.isalnum, r["text"])):
            continue
        own = ITEM_BYTES + SYMBOL_BYTES * len(r["text"])
        if size + own > bound and ids:
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(r["item_id"])
        held.append(r["text"])
        size += own
    if ids:
        yield ids, held


def _shared_items(docs: DataFrame, group: tuple[list[int], list[str]], similarity: float, recall: float):
    """The broadcast texts of a group, and what gives a task its search tables: built once by each worker, one group at a time."""
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(group)

    def build() -> Items:
        ids, texts_ = shared.value
        return Items(ids, [fold(t) for t in texts_], similarity, recall)

    return shared, lambda: held(name, build)


def found_in(group: Items, texts_: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """(position of the text, item, distance, end) of all matches, about CHUNK symbols looked at together."""
    at = size = 0
    folded: list[tuple[np.ndarray, np.ndarray]] = []
    for k, text in enumerate(texts_):
        folded.append(fold(text))
        size += len(folded[-1][0]) + 1
        if size >= CHUNK or k + 1 == len(texts_):
            wide, flat = (np.concatenate([x for f in folded for x in (f[c], np.array([PAD], f[c].dtype))]) for c in (0, 1))
            first = np.cumsum([0, *(len(f[0]) + 1 for f in folded[:-1])])
            yield from ((at + d, i, n, e) for d, i, n, e in group.matches(flat, wide, first))
            at, folded, size = k + 1, [], 0


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bound: int = GROUP_BYTES) -> DataFrame:
    """doc_id, item_id, distance, similarity and end_symbol (where the match ends in the folded text) of every document
    and item that are found together."""
    schema = "doc_id long, item_id long, distance int, similarity double, end_symbol long"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64())
    rows, parts, last = id_text(docs).filter("text is not null"), [], None
    for group in item_groups(items, bound):
        if last is not None:  # one group's broadcast at a time: the part before is written first
            parts[-1] = stored(parts[-1], "matches")
            last.destroy()
        last, get = _shared_items(docs, group, similarity, recall)

        def find(batches, get=get):
            group = get()
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[d], group.ids[i], n, 1 - n / len(group.folded[i]), e) for d, i, n, e in found_in(group, texts(batch))]
                if found:
                    cols = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "similarity", "end_symbol"])

        parts.append(rows.mapInArrow(find, schema))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def _holding(get):
    """Which texts hold an item of a group."""

    def holds(texts_: list[str | None]) -> np.ndarray:
        bad = np.zeros(len(texts_), bool)
        bad[[d for d, _, _, _ in found_in(get(), texts_)]] = True
        return bad

    return holds


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, bound: int = GROUP_BYTES) -> DataFrame:
    """`docs` without the rows whose text holds an item; columns stay. With one group of items the text is judged beside its row
    and nothing is shuffled. With more, each group's finds (two hashes of a text) are written before the next group is
    looked for, and in the end the texts meet the list of them."""
    text = F.col("text").cast("string")
    found, last = [], None
    for group in item_groups(items, bound):
        if last is not None:
            found[-1] = stored(found[-1], "found")
            last[0].destroy()
        last = _shared_items(docs, group, similarity, recall)
        holds = _holding(last[1])
        found.append(kept_rows(docs.select("text"), holds).select(F.xxhash64(text).alias("a"), F.md5(text).alias("b")))
    if len(found) < 2:
        return kept_rows(docs, lambda texts_: ~holds(texts_)) if found else docs
    gone = stored(reduce(DataFrame.unionByName, found).distinct(), "found")
    a, b = unused(docs, "a"), unused(docs, "b")
    keyed = docs.withColumns({a: F.xxhash64(text), b: F.coalesce(F.md5(text), F.lit(""))})
    return keyed.join(gone.select(F.col("a").alias(a), F.col("b").alias(b)), [a, b], "left_anti").select(*docs.columns)
