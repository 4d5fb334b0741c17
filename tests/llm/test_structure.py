"""Periodic runs, conversation repair and line dedup against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from photonlake.llm import conversation_repair, line_dedup, periodic_runs
from photonlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, runs string, row long, gone string, shard int, n long"


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "r", 1, "g", 2, 3) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- periodic runs


def plain_runs(w, least=6, copies=4):
    """Every lag by comparing words; a stretch counts under its smallest period."""
    out = {}
    for q in range(1, len(w) // copies + 1):
        start = None
        for i in range(len(w) - q + 1):
            same = i < len(w) - q and w[i] == w[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i + q - start >= max(least, copies * q):
                    out.setdefault((start, i + q), q)
                start = None
    return sorted((s, e - s, q) for (s, e), q in out.items())


def texts_with_runs(rng):
    for _ in range(300):
        k = rng.choice((1, 2, 3, 5, 50))
        w = [rng.choice("abcdefgh"[: min(k, 8)]) if k < 50 else f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            q = rng.randint(1, 40)
            block = [rng.choice(w or ["x"]) for _ in range(q)]
            if rng.random() < 0.3:
                block = block[: q // 3] * 3 + block[:1]  # a period that nearly has a shorter one
            at = rng.randint(0, len(w))
            w[at:at] = (block * rng.randint(2, 9))[: len(block) * rng.randint(2, 9) + rng.randint(0, q)]
        yield w


def test_runs_by_every_lag():
    rng = random.Random(11)
    words = list(texts_with_runs(rng))
    got = periodic_runs.runs_of_documents([[x.encode() for x in w] for w in words])
    assert sum(map(len, got)) > 200
    for w, g in zip(words, got, strict=True):
        assert g == plain_runs(w), w


def test_runs_of_long_documents():
    rng = np.random.default_rng(4)
    for q in (8, 15, 16, 17, 100, 255, 256, 1000, 4999):
        block = rng.integers(0, 3 if q < 300 else 1000, q)
        x = np.concatenate([rng.integers(2000, 3000, 777), np.tile(block, 5)[: 4 * q + q // 2], rng.integers(2000, 3000, 3333)])
        got = [r for r in periodic_runs.find_runs(x, len(x)) if r[2] == q]
        s, e, _ = got[0]
        assert len(got) == 1 and s <= 777 and e >= 777 + 4 * q + q // 2
    one = np.zeros(50_000, np.int64)
    assert periodic_runs.find_runs(one, len(one)) == [(0, 50_000, 1)]
    fib = [0, 1]
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    fib = np.array(b)
    assert [(s, e - s, q) for s, e, q in periodic_runs.find_runs(fib, len(fib))] == plain_runs(b)


def runs_row(text, doc_id):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(w) for w in itertools.islice(texts_with_runs(rng), 120)] + [None, "", " \n\t", "a " * 700, "é é é é é é é é é\n", "x"]
    ids = [*range(1, len(texts)), None]
    docs = docs_of(spark, texts, ids)
    docs.unionByName(docs.filter("doc_id = 5")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    want = sorted([runs_row(t, i) for i, t in zip(ids, texts, strict=True)] + [runs_row(texts[4], 5)], key=str)
    assert got == want
    assert sum(r[1] for r in got) > 80


# -- conversation repair


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        out += [(conv, turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    return out


def brute_repair(rows):
    """States and whole edit strings, forwards."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    least = lambda d, key, new: d.__setitem__(key, min(d.get(key, new), new))
    name = {"u": "user", "a": "assistant"}

    def with_inserts(states):
        for _ in range(3):
            for key, (cost, audit, out) in list(states.items()):
                for c in ("u", "a"):
                    if c in step[key]:
                        least(states, step[key][c], (cost + 2, audit + "I", (*out, f"{name[c]}:")))
        return states

    states = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        nxt = {}
        for key, (cost, audit, out) in with_inserts(states).items():
            least(nxt, key, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in step[key]:
                    least(nxt, step[key][role[:1]], (cost + more, audit + "K", (*out, f"{role}:{text}")))
                for c in ("u", "a"):
                    if c in step[key]:
                        least(nxt, step[key][c], (cost + 2 + more, audit + "R", (*out, f"{name[c]}:{text}")))
        states = nxt
    cost, audit, out = min(v for k, v in with_inserts(states).items() if k in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(out)))


def conversation_rows(rng):
    says = ["hello.", "what?", "no end", "", " \n", "ok!", "yes. ", None, "long " * 50 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = []
    for conv in range(250):
        for turn in range(rng.choice((0, 1, 2, 3, 5, 8, 20))):
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice((None, 3, turn)), rng.choice(roles), rng.choice(says) if rng.random() < 0.6 else f"own {conv} {turn}."))
    rows += [(None, 0, "user", "x."), (None, 1, "assistant", "y."), (-7, None, None, None), (-8, 4, "user", "z.")]
    rows += [(999, k, "su"[k > 0] + "ser", f"turn {rng.randrange(30)}" + rng.choice((".", ""))) for k in range(150)]
    return rows


def expected(rows, damage):
    by = {r[0]: [] for r in rows}
    for r in brute_damage(rows) if damage else [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]:
        by[r[0]].append(r)
    return sorted(((c, *(brute_repair(v) if v else (0, 0, 0, 0, 0, 0, "", sha("")))) for c, v in by.items()), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "p", True, 1) for r in rows], "conv_id long, turn long, role string, text string, part string, whole boolean, pos int").repartition(3)


def test_conversation_repair_query(spark, tmp_path):
    rows = conversation_rows(random.Random(7))
    table_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()), key=str)
    assert got == expected(rows, True)


def test_conversations_cut_anywhere(spark):
    """The same with every conversation cut into parts, and with parts of the table that hold a few turns."""
    rows = conversation_rows(random.Random(8))[-400:]
    for part_turns, most in ((3, 100_000), (4096, 40), (1, 30)):
        parts = conversation_repair.repair(table_of(spark, rows), part_turns, most)
        got = sorted(map(tuple, conversation_repair.digest(parts).collect()), key=str)
        assert got == expected(rows, False), (part_turns, most)


def test_all_edits_of_short_conversations():
    """Costs and edits against all strings of edits."""

    def ways(turns, inserted=2):
        if not turns:
            yield ""
        else:
            for rest in ways(turns[1:]):
                for x in "KRD":
                    yield x + rest
        if inserted:
            for rest in ways(turns, inserted - 1):
                yield "I" + rest

    def cost(audit, turns):
        k, out, total = 0, [], 0
        for x in audit:
            total += {"K": 0, "R": 2, "D": 3, "I": 2}[x]
            if x == "I":
                out.append("ua")
                continue
            initial, fault = turns[k]
            k += 1
            if x == "D":
                continue
            if fault in (conversation_repair.BLANK, conversation_repair.REPEATED):
                return None
            total += fault == conversation_repair.OPEN_END
            out.append(initial if x == "K" else "ua")
        for pattern in ("ua" * (len(out) // 2), "s" + "ua" * (len(out) // 2)):
            if len(pattern) == len(out) and pattern != "s" and all(p in o for p, o in zip(pattern, out, strict=True)):
                return total
        return None

    for turns in itertools.chain.from_iterable(itertools.product(itertools.product("sua-", range(4)), repeat=n) for n in (1, 2)):
        best = min((c, a) for a in set(ways(turns)) if (c := cost(a, turns)) is not None)
        m = conversation_repair.matrices([tuple(conversation_repair.symbol(i, f) for i, f in turns)])[0]
        assert conversation_repair.finished(m[0]) == best


def test_re_pair_spells_the_sequences():
    rng = random.Random(1)
    for _ in range(50):
        seqs = [[rng.randrange(rng.choice((1, 2, 12))) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(0, 12))]
        rules, short = conversation_repair.re_pair(seqs)
        spell = lambda c: [c] if c < 16 else [y for x in rules[c - 16] for y in spell(x)]
        assert [[y for c in s for y in spell(c)] for s in short] == seqs
        pairs = Counter()
        for s in short:
            pairs.update({(k, a, b) for k, (a, b) in enumerate(zip(s, s[1:])) if a != b})
        assert max(Counter((a, b) for _, a, b in pairs).values(), default=0) <= len(short)


# -- line dedup


def brute_lines(texts, most=10, least=1):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    counts = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= least)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < most]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(9)
    lines = [f"line {k} é" for k in range(60)] + ["", "  ", "Share THIS", " share this\t", "É", "é", " x", "x", "\x1fx"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12))) for _ in range(90)]
    return [*texts, None, "", "\n", "\n\n", "same\nline", *["copy\r\nof it\n"] * 15, "z" * 100_000]


def test_line_dedup_by_hand(spark, lined):
    for limits in ({}, {"in_documents": 3, "keys_per_shard": 7}, {"in_documents": 2, "least_chars": 2}):
        ids = [*range(len(lined) - 2), None, None]
        docs = docs_of(spark, lined, ids)
        got = sorted((tuple(r) for r in line_dedup.drop_lines(docs, **limits).collect()), key=str)
        want = brute_lines(lined, limits.get("in_documents", 10), limits.get("least_chars", 1))
        assert got == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=str), limits


def test_hot_shards_are_probed_in_parts(spark, lined, monkeypatch):
    monkeypatch.setattr(line_dedup, "ENTRIES", 20)
    docs = docs_of(spark, lined)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.drop_lines(docs).collect()}
    assert got == dict(enumerate(brute_lines(lined)))


def test_line_index_of_other_documents(spark, lined):
    """An index decides over documents that it wasn't made from; lines that it doesn't have stay."""
    index = line_dedup.line_index(docs_of(spark, lined))
    other = ["copy\nnever seen\n COPY ", "of it\nunknown"]
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in line_dedup.drop_lines(docs_of(spark, other), index=index).collect()}
    assert got == {0: (2, "never seen"), 1: (1, "unknown")}


def test_perfect_hash_is_a_bijection():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 30_000):
        keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        found = line_dedup.PerfectHash.build(keys)
        assert sorted(found.slots(keys).tolist()) == list(range(n))
        assert n < 1000 or len(found.bits) < 4.2 * n
        found.slots(rng.integers(0, 1 << 63, (50, 2)).astype(np.uint64))


def test_empty_tables(spark, tmp_path):
    docs_of(spark, ["x"]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table_of(spark, [(1, 1, "user", "x")]).limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("op11_periodic_runs", "op12_conversation_repair", "op13_line_dedup"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []
