"""Conversation structure repair by grammar-compressed dynamic programming.

A conversation is a sequence of symbols, a turn's role initial and fault. The cheapest edits that make it an optional system
turn and then pairs of user and assistant, `(s?(ua)+)?`, come from a min-plus product: a symbol is a matrix over the four
states of that pattern (nothing yet, after system, after user, after assistant), whose entries are a cost and the edits
that it takes, the ASCII-least of equally cheap ones. Re-Pair replaces the most frequent pair of neighbouring symbols by a
rule until no pair stands twice; a rule's matrix is the product of its two, made once and shared by all conversations of a
batch. Edits are ropes, joined without copying.

The product is associative and its ties can be settled piecewise: edits of one stretch that cost the same are no prefixes
of each other (one letter a turn, and an insert costs), so the first difference decides. So a conversation of any length
is cut where that suits Spark: turns are range-partitioned in order; a task settles the conversations that lie
whole inside its range, and stores turn by turn those it may see only a part of, or that have over PART_TURNS turns. Of these, parts
become matrices, one scan over a conversation's matrices in order picks states and edits for each part, and the parts' texts are
repaired where they lie. Memory is bounded by a part (PART_TURNS turns or PART_BYTES of text, or one longer text), and by
the edits of one conversation.

Faults, a turn's first one counts: blank (no character but white space), duplicate (role and text stood earlier in the
conversation), truncated (the last character but white space is none of . ! ?). Edits: K keeps a turn whose role fits, at no cost;
R gives it the role user or assistant (2); D deletes it (3), as blank and duplicate turns must be; I inserts an empty user
or assistant turn anywhere (2). Truncated turns that stay add 1.

Null roles and texts are one space. Turns go by number, nulls first, ties by role and then by the text's MD5 digest; repeated
rows are duplicates of each other. A null conv_id is a conversation. An empty table has none."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import stored

ROWS = 100_000  # of a stored part of the table
PART_TURNS, PART_BYTES = 4096, 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. STEP[state][initial] is the next one.
STATES = 4
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
SEEN = re.compile(r"[^\x20\x09-\x0D]")
CLOSED = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
FINE, BLANK, OPEN_END, REPEATED = 0, 1, 2, 3
PARTS = "conv_id long, part long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, text string"
STORED = PARTS + ", pos long, turn long, role string, digest string, fault int"
COUNTS = ("blank", "duplicate", "truncated", "illegal")

Rope = str | tuple  # a string, or two ropes and their length
Entry = tuple[int, Rope]
Matrix = tuple[tuple[Entry | None, ...], ...]


def size_of(r: Rope) -> int:
    return len(r) if isinstance(r, str) else r[2]


def joined(a: Rope, b: Rope) -> Rope:
    if not size_of(a):
        return b
    if not size_of(b):
        return a
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) <= 32 else (a, b, size_of(a) + size_of(b))


def leaves(r: Rope) -> Iterator[str]:
    stack = [r]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += [top[1], top[0]]


def spelled(r: Rope) -> str:
    return "".join(leaves(r))


def before(a: Rope, b: Rope) -> bool:
    """Whether a spells what comes before what b spells, by their first difference."""
    one, two, x, y = leaves(a), leaves(b), "", ""
    while True:
        x, y = x or next(one, ""), y or next(two, "")
        n = min(len(x), len(y))
        if x[:n] != y[:n] or not n:
            return x < y
        x, y = x[n:], y[n:]


def better(old: Entry | None, new: Entry) -> Entry:
    return new if old is None or new[0] < old[0] or (new[0] == old[0] and before(new[1], old[1])) else old


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: a's symbols, then b's."""
    out = []
    for row in a:
        own: list[Entry | None] = [None] * STATES
        for m, left in enumerate(row):
            if left is not None:
                for j, right in enumerate(b[m]):
                    if right is not None and (own[j] is None or left[0] + right[0] <= own[j][0]):
                        own[j] = better(own[j], (left[0] + right[0], joined(left[1], right[1])))
        out.append(tuple(own))
    return tuple(out)


def inserts(state: int) -> list[tuple[int, int, str]]:
    """Where inserted turns can lead from a state, as (state, cost, edits)."""
    out, at = [(state, 0, "")], state
    for k in (1, 2):
        at = STEP[at].get("u", STEP[at].get("a"))
        out.append((at, k * INSERT, "I" * k))
    return out


def symbol(initial: str, fault: int) -> int:
    return "sua".find(initial) % 4 * 4 + fault if initial else 12 + fault


def symbol_matrix(code: int) -> Matrix:
    """The ways over one turn: inserts before it, then what happens to it."""
    initial, fault = "sua-"[code // 4], code % 4
    must, more = fault in (BLANK, REPEATED), TRUNCATED if fault == OPEN_END else 0
    rows = []
    for state in range(STATES):
        own: list[Entry | None] = [None] * STATES
        for at, cost, edits in inserts(state):
            ways = [(at, DELETE, "D")]
            if not must:
                ways += [(STEP[at][initial], KEEP + more, "K")] if initial in STEP[at] else []
                ways += [(STEP[at][c], REROLE + more, "R") for c in NAMES if c in STEP[at]]
            for to, price, letter in ways:
                own[to] = better(own[to], (cost + price, edits + letter))
        rows.append(tuple(own))
    return tuple(rows)


SYMBOLS = [symbol_matrix(code) for code in range(16)]
NOTHING: Matrix = tuple(tuple((0, "") if i == j else None for j in range(STATES)) for i in range(STATES))


def closing(state: int) -> tuple[int, str] | None:
    """The inserts that end the pattern after a state."""
    return next(((cost, edits) for at, cost, edits in inserts(state) if at in ACCEPTED), None)


def re_pair(sequences: Sequence[Sequence[int]]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules, each two symbols or earlier rules (numbered from 16 on), and the sequences in them: the most frequent pair is
    replaced, from left to right, until none stands twice."""
    ends = np.cumsum([len(s) + 1 for s in sequences])
    x = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
    for s, end in zip(sequences, ends, strict=True):
        x[end - 1 - len(s) : end - 1] = s
    rules: list[tuple[int, int]] = []
    while len(x) > 1:
        code = np.where((x[:-1] >= 0) & (x[1:] >= 0), x[:-1] << 32 | x[1:], -1)
        kinds, counts = np.unique(code[code >= 0], return_counts=True)
        if not len(kinds) or counts.max() < 2:
            break
        pair = int(kinds[counts.argmax()])
        at = np.flatnonzero(code == pair)
        if pair >> 32 == pair & 0xFFFFFFFF:  # every second of overlapping ones
            begin = np.r_[True, np.diff(at) > 1]
            at = at[(np.arange(len(at)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]) % 2 == 0]
        x[at] = 16 + len(rules)
        rules.append((pair >> 32, pair & 0xFFFFFFFF))
        x = np.delete(x, at + 1)
    parts = np.split(x, np.flatnonzero(x < 0) + 1)[:-1]
    return rules, [p[:-1].tolist() for p in parts]


def matrices(sequences: Sequence[tuple[int, ...]]) -> list[Matrix]:
    """The product of each sequence of symbols; equal sequences are worked out once, rules are evaluated bottom-up."""
    distinct = list(dict.fromkeys(sequences))
    rules, short = re_pair(distinct)
    known = list(SYMBOLS)
    for a, b in rules:
        known.append(times(known[a], known[b]))
    found = {}
    for key, codes in zip(distinct, short, strict=True):
        m = NOTHING
        for c in codes:
            m = times(m, known[c])
        found[key] = m
    return [found[s] for s in sequences]


def finished(row: Sequence[Entry | None]) -> tuple[int, str]:
    """The cheapest way of a whole conversation from its states' entries."""
    best: Entry | None = None
    for state, entry in enumerate(row):
        end = closing(state)
        if entry is not None and end is not None:
            best = better(best, (entry[0] + end[0], joined(entry[1], end[1])))
    return best[0], spelled(best[1])


def fault_of(text: str) -> int:
    return BLANK if not SEEN.search(text) else FINE if CLOSED.search(text) else OPEN_END


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def replayed(audit: str, state: int, roles: Sequence[str], texts: Sequence[str]) -> tuple[list[str], int]:
    """The turns that the edits leave, as `role:text`, and the state after them."""
    out, k = [], 0
    for letter in audit:
        if letter == "D":
            k += 1
            continue
        role, text = ("", "") if letter == "I" else (roles[k], texts[k])
        if letter != "K":
            role = next(NAMES[c] for c in NAMES if c in STEP[state])
        k += letter != "I"
        out.append(f"{role}:{text}")
        state = STEP[state][role[0]]
    return out, state


class Turns(NamedTuple):
    """Neighbouring turns of one conversation."""

    conv: int | None
    pos: list[int]
    turn: list[int | None]
    role: list[str]
    text: list[str]
    digest: list[str]


def _turn_counts(turns: Sequence[int | None]) -> tuple[int | None, int | None, int]:
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], 1 + sum(a != b for a, b in zip(known, known[1:]))) if known else (None, None, 0)


def settled(group: list[Turns]) -> pa.RecordBatch:
    """STORED rows of whole conversations."""
    faults, keys = [], []
    for c in group:
        seen: set[tuple[str, str]] = set()
        own = []
        for role, text, digest in zip(c.role, c.text, c.digest, strict=True):
            fault = fault_of(text)
            own.append(REPEATED if fault != BLANK and (role, digest) in seen else fault)
            seen.add((role, digest))
        faults.append(own)
        keys.append(tuple(symbol(r[:1], f) for r, f in zip(c.role, own, strict=True)))
    rows = []
    for c, own, m in zip(group, faults, matrices(keys), strict=True):
        cost, audit = finished(m[0])
        lines, _ = replayed(audit, 0, c.role, c.text)
        first, last, n = _turn_counts(c.turn)
        gaps = last - first + 1 - n if n else 0
        rows.append((c.conv, c.pos[0], True, gaps, own.count(BLANK), own.count(REPEATED), own.count(OPEN_END), illegal_pairs([r[:1] for r in c.role]), cost, audit, "\n".join(lines), *[None] * 5))
    return _batch(rows, STORED)


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def ordered(conversations: DataFrame, rows: int = ROWS) -> DataFrame:
    """The turns in order; `pos` is a row's place among all. Equal rows are parted by where they came from, so a row repeated
    without bound is spread over tasks, too."""
    df = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    df = df.withColumns({"digest": F.md5("text"), "_from": F.monotonically_increasing_id()})
    keys = ("conv_id", "turn", "role", "digest", "_from")
    df = df.repartitionByRange(max(1, math.ceil(df.count() / rows)), *keys).sortWithinPartitions(*keys)
    return df.withColumn("pos", F.monotonically_increasing_id()).select("conv_id", "pos", "turn", "role", "text", "digest")


def stretches(batches: Iterator[pa.RecordBatch], part_turns: int) -> Iterator[tuple[Turns, bool]]:
    """Each conversation's neighbouring turns, and whether they are the whole conversation: turns of others stand before and
    behind them."""
    own: Turns | None = None
    opened, size = True, 0  # whether what came before the own turns is unknown, or of the same conversation
    for batch in batches:
        for conv, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own is not None and (conv != own.conv or len(own.pos) >= part_turns or size > PART_BYTES):
                yield own, conv != own.conv and not opened
                opened, own = conv == own.conv, None
            if own is None:
                own, size = Turns(conv, [], [], [], [], []), 0
            for column, value in zip(own[1:], turn, strict=True):
                column.append(value)
            size += len(own.text[-1])
    if own is not None:
        yield own, False


def _settle(part_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[Turns] = []
        size = 0
        for own, whole in stretches(batches, part_turns):
            if not whole:
                unknown = [None] * 7  # counts, cost and audit
                yield _batch([(own.conv, own.pos[0], False, *unknown, text, pos, turn, role, digest, fault_of(text)) for pos, turn, role, text, digest in zip(*own[1:], strict=True)], STORED)
                continue
            group.append(own)
            size += sum(map(len, own.text)) + 100 * len(own.pos)
            if size > PART_BYTES:
                yield settled(group)
                group, size = [], 0
        if group:
            yield settled(group)

    return run


MATRICES = f"conv_id long, part long, {', '.join(f'{c} long' for c in COUNTS)}, first string, last string, t_first long, t_last long, t_n long, costs array<long>, audits array<string>"
CHOSEN = f"conv_id long, part long, state int, gaps long, {', '.join(f'{c} long' for c in COUNTS)}, cost long, audit string"


def part_matrix(rows: pa.Table) -> pa.Table:
    """The counts and the matrix of one part; `new` marks turns that stand first in their conversation."""
    df = rows.sort_by("pos")
    fault = [REPEATED if f != BLANK and not new else f for f, new in zip(df.column("fault").to_pylist(), df.column("new").to_pylist(), strict=True)]
    initials = [r[:1] for r in df.column("role").to_pylist()]
    m = matrices([tuple(symbol(i, f) for i, f in zip(initials, fault, strict=True))])[0]
    entries = [e for row in m for e in row]
    out = (df.column("conv_id")[0].as_py(), df.column("part")[0].as_py(), fault.count(BLANK), fault.count(REPEATED), fault.count(OPEN_END), illegal_pairs(initials), initials[0], initials[-1], *_turn_counts(df.column("turn").to_pylist()), [None if e is None else e[0] for e in entries], [None if e is None else spelled(e[1]) for e in entries])
    return pa.Table.from_batches([_batch([out], MATRICES)])


class _Way(NamedTuple):
    """A way through the parts so far: the last part's entry state and edits, and the way before it."""

    past: _Way | None
    state: int
    edits: str


def way_before(a: _Way, b: _Way, more_a: str = "", more_b: str = "") -> bool:
    """Whether a's edits come before b's, which have as many parts; both are compared from their last common way on."""
    one, two = [more_a], [more_b]
    while a is not b:
        one.append(a.edits)
        two.append(b.edits)
        a, b = a.past, b.past
    return "".join(reversed(one)) < "".join(reversed(two))


def chosen_ways(parts: list[dict]) -> list[tuple]:
    """CHOSEN rows of a conversation's parts in order; the first has what is counted between parts, and the whole cost."""
    now: list[tuple[int, _Way] | None] = [(0, _Way(None, -1, "")), None, None, None]
    for p in parts:
        nxt: list[tuple[int, _Way] | None] = [None] * STATES
        for i, here in enumerate(now):
            for j in range(STATES):
                if here is None or p["costs"][i * STATES + j] is None:
                    continue
                cost, way = here[0] + p["costs"][i * STATES + j], _Way(here[1], i, p["audits"][i * STATES + j])
                if nxt[j] is None or cost < nxt[j][0] or (cost == nxt[j][0] and way_before(way, nxt[j][1])):
                    nxt[j] = (cost, way)
        now = nxt
    best: tuple[int, _Way, str] | None = None
    for state, here in enumerate(now):
        end = closing(state)
        if here is not None and end is not None:
            cost = here[0] + end[0]
            if best is None or cost < best[0] or (cost == best[0] and way_before(here[1], best[1], end[1], best[2])):
                best = (cost, here[1], end[1])
    cost, way, tail = best
    ways = []
    while way.past is not None:
        ways.append(way)
        way = way.past
    ways.reverse()
    known = [p for p in parts if p["t_n"]]
    distinct = sum(p["t_n"] for p in known) - sum(a["t_last"] == b["t_first"] for a, b in zip(known, known[1:]))
    gaps = known[-1]["t_last"] - known[0]["t_first"] + 1 - distinct if known else 0
    between = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
    out = []
    for k, (p, w) in enumerate(zip(parts, ways, strict=True)):
        first = k == 0
        out.append((p["conv_id"], p["part"], w.state, gaps if first else 0, p["blank"], p["duplicate"], p["truncated"], p["illegal"] + (between if first else 0), cost if first else 0, w.edits + (tail if k == len(parts) - 1 else "")))
    return out


def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over matrices by conversation and part: the states and edits of each part."""
    own: list[dict] = []
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
            if own and row["conv_id"] != own[0]["conv_id"]:
                yield _batch(chosen_ways(own), CHOSEN)
                own = []
            own.append(row)
    if own:
        yield _batch(chosen_ways(own), CHOSEN)


def repair_part(rows: pa.Table, choice: pa.Table) -> pa.Table:
    rows, c = rows.sort_by("pos"), choice.to_pylist()[0]
    lines, _ = replayed(c["audit"], c["state"], rows.column("role").to_pylist(), rows.column("text").to_pylist())
    out = (c["conv_id"], c["part"], False, c["gaps"], *(c[k] for k in COUNTS), c["cost"], c["audit"], "\n".join(lines) if lines else None)
    return pa.Table.from_batches([_batch([out], PARTS)])


def repair(conversations: DataFrame, part_turns: int = PART_TURNS, rows: int = ROWS) -> DataFrame:
    """The repaired conversations in parts: conv_id, part (grows along the conversation), whether it is the whole one, counts
    and cost (those of a conversation are its parts' sums), `audit` (the edits' initials, to be joined) and `text`: the turns that
    stay as `role:text` lines, to be joined by line breaks; null for a part of which none stays. Most conversations have one
    part; one too long for a task has many."""
    known = stored(ordered(conversations, rows).mapInArrow(_settle(part_turns), STORED), "turns")
    whole, cut = known.filter("whole").select(*(f.split()[0] for f in PARTS.split(", "))), known.filter("not whole")
    first = cut.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    marked = cut.select("conv_id", "part", "pos", "turn", "role", "fault").join(first, "pos", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    seen = marked.groupBy("part").applyInArrow(part_matrix, MATRICES)
    chosen = seen.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(choose, CHOSEN)
    texts = cut.select("part", "pos", "role", "text")
    return whole.unionByName(texts.groupBy("part").cogroup(chosen.groupBy("part")).applyInArrow(repair_part, PARTS))


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TOTALS = ("gaps", *COUNTS, "cost")


def digest(parts: DataFrame) -> DataFrame:
    """One row a conversation from `repair`'s parts: counts, cost, audit and the SHA-256 of the repaired turns. Whole ones are
    hashed where they lie; parts are read in order, one at a time."""
    whole = parts.filter("whole").select("conv_id", *TOTALS, "audit", F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sums, audit, hashed, any_ = None, None, [], None, False
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if sums is None or row["conv_id"] != conv:
                    if sums is not None:
                        yield _batch([(conv, *sums, "".join(audit), hashed.hexdigest())], DIGEST)
                    conv, sums, audit, hashed, any_ = row["conv_id"], [0] * len(TOTALS), [], hashlib.sha256(), False
                sums = [s + row[c] for s, c in zip(sums, TOTALS, strict=True)]
                audit.append(row["audit"])
                if row["text"] is not None:
                    hashed.update((("\n" if any_ else "") + row["text"]).encode())
                    any_ = True
        if sums is not None:
            yield _batch([(conv, *sums, "".join(audit), hashed.hexdigest())], DIGEST)

    cut = parts.filter("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, DIGEST)
    return whole.unionByName(cut)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with a twentieth each dropped, emptied, robbed of . ! ?, repeated, and given the role user,
    by a hash of conversation and turn. Nulls are one space, in the hash, too."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), (F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn"))) % 20).alias("_c"))
    df = df.filter("_c <> 0").withColumns({"role": F.when(F.col("_c") == 4, "user").otherwise(F.col("role")), "text": F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))})
    return df.withColumn("_k", F.explode(F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_c", "_k")


def repaired_query(conversations: DataFrame) -> DataFrame:
    """The digest of the damaged conversations, repaired, and zeros for those that have no turns left."""
    found = digest(repair(damaged(conversations))).withColumnRenamed("conv_id", "_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in TOTALS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


__all__ = ["damaged", "digest", "matrices", "re_pair", "repair", "repaired_query"]
