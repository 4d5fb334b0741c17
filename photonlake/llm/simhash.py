"""SimHash near-duplicates through vantage-point trees.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Distinct fingerprints are linked
at `radius` or fewer differing bits. Two such fingerprints differ in at most half the radius (rounded down) in one half
of the bits, so there are two trees, one for each half: every node holds a vantage point and the median distance of a
bounded sample to it, and splits what reaches it into near and far. A fingerprint lives in one leaf of a tree; as a
query it enters every branch that the triangle bound can't exclude, so it meets each partner in the partner's leaf.
Leaves are shards: links are found there exactly, over all 64 bits, and every shard returns a spanning forest and not
all pairs. Shards with many residents are dealt out in blocks, which every visitor enters.

Null texts and texts without words have fingerprint 0, which is linked like any other. Repeated rows stay repeated; the
trees are built on a bounded sample (`sample` fingerprints), everything else sees all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import arrow_map, bounded_sample, byte_texts, dropped, id_text, mixed, slices, stored, unused
from photonlake.llm.components import components

WORDS = 3
SEED = 42
RADIUS = 3
SAMPLE = 1 << 15
LEAF = 512
BLOCK = 4096
#: Of the stage that removes near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 5
GROUPED = 200_000
#: Pairs that are compared at once; members of a sample beyond which it is cut into blocks that meet two by two.
PAIRS = 1 << 19
CROWD = 4096
SALTS = np.random.default_rng(3).integers(1, 1 << 63, 4, np.uint64)
TIMES = np.random.default_rng(4).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
PLUS = np.random.default_rng(5).integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def fingerprint(data: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Of UTF-8 bytes; bytes.lower() and split() know ASCII only, which is what the definition asks for."""
    parts = (data or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[-n:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in byte_texts(batch)], np.uint64).view(np.int64)
        return pa.record_batch([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return arrow_map(id_text(docs), run, "doc_id long, fp long")


def grow(points: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree (children of node k: 2k+1 near, 2k+2 far), from a sample."""
    rng = np.random.default_rng(seed)
    vantage, radius = np.zeros(2**depth - 1, np.uint64), np.full(2**depth - 1, -1, np.int16)
    todo = [(0, points)]
    while todo:
        node, own = todo.pop()
        if node >= len(vantage):
            continue
        if len(own):
            vantage[node] = own[rng.integers(len(own))]
            d = np.bitwise_count(own ^ vantage[node]).astype(np.int16)
            radius[node] = np.int16(np.sort(d)[(len(d) - 1) // 2])
            todo += [(2 * node + 1, own[d <= radius[node]]), (2 * node + 2, own[d > radius[node]])]
    return vantage, radius


def leaves(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in x, leaf) for every leaf that may hold a point within `radius`; 0 gives each point its own leaf."""
    vantage, median = tree
    at, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    while len(node) and node[0] < len(vantage):
        d = np.bitwise_count(x[at] ^ vantage[node]).astype(np.int16)
        near, far = d - radius <= median[node], d + radius > median[node]
        at, node = np.r_[at[near], at[far]], np.r_[2 * node[near] + 1, 2 * node[far] + 2]
    return at, node - len(vantage)


def half(fp: np.ndarray, k: int) -> np.ndarray:
    return fp & np.uint64(0xFFFFFFFF) if k == 0 else fp >> np.uint64(32)


def forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every position the position with the smallest id of its component under the links a-b."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label, a, b = np.arange(len(ids)), rank[a], rank[b]
    while True:
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, a, low)
        np.minimum.at(nxt, b, low)
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        nxt = nxt[nxt]
        if (nxt == label).all():
            return order[label[rank]]
        label = nxt


def shard_links(home: np.ndarray, home_id: np.ndarray, guest: np.ndarray, guest_id: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a shard's residents and its visitors, as id pairs."""
    left, right = [], []
    step = max(1, (1 << 21) // max(1, len(home)))
    for at in range(0, len(guest), step):
        g, h = (np.bitwise_count(guest[at : at + step, None] ^ home[None, :]) <= radius).nonzero()
        other = guest_id[at + g] != home_id[h]
        left.append(at + g[other])
        right.append(h[other])
    g, h = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
    if not len(g):
        return guest_id[:0], guest_id[:0]
    ids, at = np.unique(np.r_[guest_id[g], home_id[h]], return_inverse=True)
    root = forest(ids, at[: len(g)], at[len(g) :])
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def near_links(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """Links (a, b) that join exactly the fingerprints within `radius` of each other, directly or over others. `fps`:
    distinct fp with an id each."""
    spark = fps.sparkSession
    n = fps.count()
    part = bounded_sample(fps, "fp", n, sample, 3).select("fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    depth = max(0, min(math.ceil(math.log2(max(1, n / leaf))), int(math.log2(max(1, len(part) / 4)))))
    trees = [grow(half(part, k), depth, 11 + k) for k in (0, 1)]
    shared = spark.sparkContext.broadcast(trees)

    def at_home(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            for k, tree in enumerate(shared.value):
                shard = np.bincount(leaves(half(fp, k), tree, 0)[1], minlength=2**depth)
                own = shard.nonzero()[0]
                yield pa.record_batch([pa.array(np.full(len(own), k, np.int32)), pa.array(own.astype(np.int32)), pa.array(shard[own])], ["tree", "shard", "n"])

    sizes = np.ones((2, 2**depth), np.int64)
    for r in fps.mapInArrow(at_home, "tree int, shard int, n long").groupBy("tree", "shard").agg(F.sum("n").alias("n")).collect():  # 2 x leaves rows
        sizes[r["tree"], r["shard"]] = max(1, -(-r["n"] // BLOCK))
    blocks = spark.sparkContext.broadcast(sizes)

    def deal(batches):
        """For each shard and block that rows of this batch live in or visit: their fingerprints and ids, packed."""
        for b in batches:
            fp, ids = b.column("fp").to_numpy().view(np.uint64), b.column("id").to_numpy()
            for k, tree in enumerate(shared.value):
                of = blocks.value[k]
                at, shard = leaves(half(fp, k), tree, radius // 2)
                home = np.empty(len(fp), np.int64)
                into, live = leaves(half(fp, k), tree, 0)
                home[into] = live
                own = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % of[home]
                rep = np.repeat(np.arange(len(at)), of[shard])
                block = np.arange(len(rep)) - np.repeat(np.cumsum(of[shard]) - of[shard], of[shard])
                at, shard = at[rep], shard[rep]
                lives = (home[at] == shard) & (own[at] == block)
                order = np.lexsort((block, shard))
                cut = np.flatnonzero(np.r_[True, (np.diff(shard[order]) != 0) | (np.diff(block[order]) != 0)]) if len(order) else np.zeros(0, int)
                groups = np.split(order, cut[1:])
                if len(order):
                    yield pa.record_batch([pa.array([k] * len(groups), pa.int32()), pa.array(shard[order[cut]].astype(np.int32)), pa.array(block[order[cut]].astype(np.int32)), *(pa.array([x[at[g]].tobytes() for g in groups], pa.binary()) for x in (fp, ids)), pa.array([lives[g].tobytes() for g in groups], pa.binary())], ["tree", "shard", "block", "fps", "ids", "lives"])

    def link(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        fp, ids, lives = join("fps", np.uint64), join("ids", np.int64), join("lives", bool)
        a, b = shard_links(fp[lives], ids[lives], fp, ids, radius)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = fps.select("fp", "id").mapInArrow(deal, "tree int, shard int, block int, fps binary, ids binary, lives binary")
    return dealt.groupBy("tree", "shard", "block").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach). Rows without a doc_id get a
    fingerprint, and the component of an equal one if there is one, else none."""
    rows = stored(fingerprints(docs), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    roots = components(near_links(fps.filter("id is not null"), radius))
    classes = fps.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return rows.join(classes, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(data: bytes | None) -> tuple[bytes, np.ndarray]:
    """The 256-bit fingerprint of a text's set of SHINGLE-word shingles, and the keys of its BANDS min-wise samples."""
    parts = (data or b"").lower().split()
    if not parts:
        return bytes(32), np.zeros(BANDS, np.uint64)
    joined = b" ".join(parts)
    n = max(1, len(parts) - SHINGLE + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array(list({digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist(), strict=True)}), np.uint64)
    ones, least = np.zeros(256, np.int64), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 1 << 12):
        own = h[at : at + (1 << 12)]
        wide = np.stack([mixed(own ^ salt) for salt in SALTS], 1)
        ones += np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        low = (own >> np.uint64(32)).astype(np.uint32)
        least = np.minimum(least, (low[:, None] * TIMES + PLUS).min(0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes(), keys


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), fp (32 bytes) and keys of every row with a doc_id."""

    def run(batches):
        for batch in slices(batches):
            found = [sketch(t) for t in byte_texts(batch)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array([f for f, _ in found], pa.binary()), pa.array([k.tobytes() for _, k in found], pa.binary())], ["doc_id", "row", "fp", "keys"])

    rows = id_text(docs).filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, fp binary, keys binary")


def farthest(similarity: float) -> int:
    """The bits of 256 in which texts of this Jaccard similarity differ on average: sets of equal size enclose the angle
    whose cosine is 2 s / (1 + s)."""
    return int(256 * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def apart(fp: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp ^ other).sum(-1, dtype=np.int64)


def group_links(fp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join exactly the members within `most` bits of each other, directly or over others. Members near a leader
    are one cluster; leaders are further apart, so only the other members are compared with all, some rows at a time, and
    join clusters."""
    n, left = len(fp), np.arange(len(fp))
    name, out = np.arange(n), []
    while len(left):
        near = apart(fp[left], fp[left[0]]) <= most
        own = left[near]
        name[own] = own[0]
        out += [(int(own[0]), x) for x in own[1:].tolist()]
        left = left[~near]
    led = np.flatnonzero(name != np.arange(n))
    rows = max(1, PAIRS // max(1, n))
    for at in range(0, len(led), rows):
        if not (name != name[0]).any():
            break
        own = led[at : at + rows]
        near = apart(fp[own][:, None], fp[None]) <= most
        for x, found in zip(own.tolist(), near, strict=True):
            others = found.nonzero()[0]
            others = others[name[others] != name[x]]
            while len(others):
                y = int(others[0])
                out.append((y, x))
                name[name == name[y]] = name[x]
                others = others[name[others] != name[x]]
    return out


def runs_of(keys: np.ndarray) -> list[np.ndarray]:
    """Positions of each key that stands twice or more."""
    order = np.argsort(keys, kind="stable")
    cut = np.flatnonzero(np.diff(keys[order])) + 1
    begin, end = np.r_[0, cut], np.r_[cut, len(order)]
    many = end - begin > 1
    return [order[a:b] for a, b in zip(begin[many].tolist(), end[many].tolist(), strict=True)]


DEALT = "bucket int, block int, other int, keys binary, ids binary, fps binary"


def _packed(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, n: int, block: np.ndarray | None = None, other: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a bucket (of n, by key) and pair of blocks."""
    bucket = (keys % np.uint64(n)).astype(np.int32)
    block, other = (np.zeros(len(keys), np.int32) if x is None else x for x in (block, other))
    order = np.lexsort((other, block, bucket))
    new = (np.diff(bucket[order]) != 0) | (np.diff(block[order]) != 0) | (np.diff(other[order]) != 0)
    groups = np.split(order, np.flatnonzero(new) + 1) if len(order) else []
    return pa.record_batch([*(pa.array([int(x[g[0]]) for g in groups], pa.int32()) for x in (bucket, block, other)), *(pa.array([x[g].tobytes() for g in groups], pa.binary()) for x in (keys, ids, fps))], ["bucket", "block", "other", "keys", "ids", "fps"])


def _unpacked(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    join = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
    return join("keys", np.uint64), join("ids", np.int64), join("fps", np.uint64).reshape(-1, 4)


def sample_links(classes: DataFrame, most: int, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between distinct fingerprints that share a sample and lie within `most` bits. Before the shuffle, a batch
    links what lies within a quarter of that of the first member it has of a sample, and sends only the others. A sample
    with over `crowd` members left is cut into blocks by id, and every two blocks meet in a task of their own."""
    n = max(8, classes.count() * BANDS // GROUPED)

    def near_first(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent, pairs = np.ones(len(keys), bool), [np.zeros((0, 2), np.int64)]
        for own in runs_of(keys):
            near = apart(fps[at[own]], fps[at[own[0]]]) <= most // 4
            near[0] = False
            sent[own[near]] = False
            pairs.append(np.stack([np.full(int(near.sum()), ids[at[own[0]]]), ids[at[own[near]]]], 1))
        return sent, np.unique(np.concatenate(pairs), axis=0)

    def deal(batches):
        for b in batches:
            ids, fps = b.column("id").to_numpy(), np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(-1, 4)
            keys, at = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.uint64), np.repeat(np.arange(len(ids)), BANDS)
            sent, pairs = near_first(keys, ids, fps, at)
            k = sent.nonzero()[0]
            yield _packed(keys[k], ids[at[k]], fps[at[k]], n)
            if len(pairs):  # links already: a row without keys
                yield pa.record_batch([pa.array([-1], pa.int32()), *(pa.array([0], pa.int32()) for _ in range(2)), pa.array([b""], pa.binary()), pa.array([pairs.tobytes()], pa.binary()), pa.array([b""], pa.binary())], ["bucket", "block", "other", "keys", "ids", "fps"])

    dealt = stored(classes.select("id", "fp", "keys").mapInArrow(deal, DEALT), "samples")

    def paired(batches):
        for b in batches:
            for ids in b.column("ids").to_pylist():
                pairs = np.frombuffer(ids, np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def counted(batches):
        for b in batches:
            keys, c = np.unique(_unpacked(b)[0], return_counts=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(c)], ["key", "n"])

    def link(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, ids, fps = _unpacked(table)
        found = [(ids[own[a]], ids[own[b]]) for own in runs_of(keys) for a, b in group_links(fps[own], most)]
        new = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
        return pa.table([pa.array(new[:, 0]), pa.array(new[:, 1])], ["a", "b"])

    links = dealt.filter("bucket < 0").mapInArrow(paired, "a long, b long")
    dealt = dealt.filter("bucket >= 0")
    crowded = dealt.select("keys", "ids", "fps").mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > crowd)
    crowded = stored(crowded.select("key", F.ceil(F.col("n") / crowd).cast("int").alias("blocks")), "crowded")
    if not crowded.isEmpty():
        dealt = blocks_of(dealt, crowded, n)
    return links.unionByName(dealt.groupBy("bucket", "block", "other").applyInArrow(link, "a long, b long"))


def blocks_of(dealt: DataFrame, crowded: DataFrame, n: int) -> DataFrame:
    """DEALT rows in which the members of a crowded key (with its number of `blocks`) stand in a row for each pair that their own
    block is in; the others stand where they were. Rows are split before they are grouped, so no task sees a whole crowd."""

    def rows(batches):
        for b in batches:
            keys, ids, fps = _unpacked(b)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(ids), pa.array([f.tobytes() for f in fps], pa.binary())], ["key", "id", "fp"])

    def deal(batches):
        for b in batches:
            keys, ids, fps = b.column("key").to_numpy().view(np.uint64), b.column("id").to_numpy(), np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(-1, 4)
            blocks = b.column("blocks").fill_null(1).to_numpy().astype(np.int64)
            own = (mixed(ids.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(ids)), blocks)
            met = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            for k in range(0, len(at), 1 << 16):
                p, m = at[k : k + (1 << 16)], met[k : k + (1 << 16)]
                yield _packed(keys[p], ids[p], fps[p], n, np.minimum(own[p], m).astype(np.int32), np.maximum(own[p], m).astype(np.int32))

    each = dealt.select("keys", "ids", "fps").mapInArrow(rows, "key long, id long, fp binary").join(crowded, "key", "left")
    return each.select("key", "id", "fp", "blocks").mapInArrow(deal, DEALT)


def same_links(classes: DataFrame) -> DataFrame:
    """Links between classes of one fingerprint with different samples."""
    least = classes.groupBy("fp").agg(F.min("id").alias("a"), F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("_fp"), "a")
    return classes.join(least, F.col("fp") == F.col("_fp")).filter("id <> a").select("a", F.col("id").alias("b"))


def tree_links(classes: DataFrame) -> DataFrame:
    """Links between fingerprints whose first 64 bits the vantage-point trees find within RADIUS: of texts as alike as 0.7 one
    pair in a thousand is that near. Of several with equal first bits one is looked for; samples find the others."""
    head = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")
    return near_links(stored(classes.groupBy(head.alias("fp")).agg(F.min("id").alias("id")), "heads"))


def repeated(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row) of what goes: all but the smallest of each component of near duplicates; and of what stays, but stands on
    several equal rows."""
    rows = stored(sketches(docs), "sketches")
    first = rows.groupBy("fp", "keys").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    classes = stored(first.withColumn("id", F.monotonically_increasing_id()), "classes")
    most = farthest(similarity)
    roots = components(sample_links(classes, most).unionByName(tree_links(classes)).unionByName(same_links(classes)))
    joined = classes.select("id", "least").join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    kept = joined.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.row")
    kept = stored(kept, "kept")
    gone = rows.select("doc_id", "row").distinct().join(kept.hint("merge"), ["doc_id", "row"], "left_anti")
    again = rows.groupBy("doc_id", "row").count().filter("count > 1").select("doc_id", "row").join(kept.hint("merge"), ["doc_id", "row"], "left_semi")
    gone, again = stored(gone, "gone"), stored(again, "again")
    for past in (rows, classes, roots, kept):
        dropped(past)
    return gone, again


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row for each group of near duplicates, the one with the smallest doc_id (of several rows with it, the
    one with the smallest text hash). Near duplicates: SHINGLE-word shingles of Jaccard similarity `similarity` or more, as
    the 256-bit fingerprints tell it (standard error about 0.04). 3 of 64 bits, as the trees search, hold little more than
    copies; so candidates also come from equal min-wise samples of ROWS shingles each, of which texts of similarity 0.8 share
    one of BANDS with probability 0.99.

    Rows without a doc_id stay; of rows equal in doc_id and text one stays (the least by a hash of all columns). Null texts
    and texts without words are one group. Columns stay, whatever their names. The list of what goes grows with the input, so
    it is never broadcast: the texts are shuffled once to meet it, in hash tables of two longs a row, and aren't sorted."""
    gone, again = repeated(docs.select("doc_id", "text"), similarity)
    key, row = unused(docs, "key"), unused(docs, "row")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(row, F.xxhash64(F.col("text").cast("string")))
    own = lambda df: df.select(F.col("doc_id").alias(key), F.col("row").alias(row))
    kept = keyed.join(own(gone).hint("shuffle_hash"), [key, row], "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    whole = F.struct(*docs.columns)
    again = own(again).hint("shuffle_hash")
    one = kept.join(again, [key, row], "left_semi").groupBy(key, row).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("kept")).select("kept.*")
    return kept.join(again, [key, row], "left_anti").select(*docs.columns).unionByName(one)
