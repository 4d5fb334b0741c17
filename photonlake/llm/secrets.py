"""Secret scans: fixed patterns, and a guess-cost search over values that stand in a credential context.

Three base kinds are matched leftmost and without overlap, each on its own: `assign`, `access` and `hex`. Beyond them,
a value after a wider set of credential words (with `:`, `=` or "is") is priced by dynamic programming: the cheapest
segmentation into dictionary words, dates, repeats, sequences, keyboard walks and brute-force spans, in log10 guesses. The
dictionary is the frequent password words below and the `DICTIONARY` words that most documents hold, counted over all of
them outside such contexts, so that prose ("the password is important") costs little.
Values that cost at least `min_log10` guesses are reported as kind `guess`, unless they lie inside an `assign` match; one
that reaches further is reported beside it. A value of any length is taken whole: a quoted one (behind : or =) to the closing
quote on its line, spaces and all; another to the next white space or CJK character.

Nulls count as empty texts: no spans. An empty table gives no rows. Positions are code points, ends exclusive. Repeated rows are scanned row by row.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import arrow_map, held, id_text, slices, stored, texts

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, perhaps a closing quote or bracket, and a separator; behind : or = (and at most one line break) a quoted
#: value up to its closing quote on that line, else (and behind "is") what goes on to the next white space, without CJK.
_WORD = r"""(?i:(?<![A-Za-z0-9])(?:pass|pwd|passphrase|passcode|password|passwd|secret|token|api[_-]?key|auth|credentials?|private[_-]?key|access[_-]?key|client[_-]?key|login))["'\])}\uff09\u3011\u300d\u300f]{0,3}"""
_BARE = r"""["'\u201c]?([^\s"'\u201c\u201d\u3000-\u9fff\uac00-\ud7af\uff00-\uffef][^\s\u3000-\u9fff\uac00-\ud7af\uff00-\uffef]{5,})"""
CONTEXT = re.compile(rf"""{_WORD}(?:[\x20\t]*[:=\uff1a][\x20\t]*(?:\r?\n[\x20\t]*)?(?:"((?:\\[^\r\n]|[^"\\\r\n]){{6,}})"|'((?:\\[^\r\n]|[^'\\\r\n]){{6,}})'|\u201c([^\u201d\r\n]{{6,}})\u201d|{_BARE})|\x20is\x20{_BARE})""")
QUOTED = 3  # the first groups
CLOSING = "\"',;)]}>\u201d\u00bb"
CONTEXT_WORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "login")
KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10 = 8.0
LONG = 64
ORDER = 0.3
DICTIONARY, IN_DOCUMENTS, HELD_WORDS = 50_000, 5, 200_000
LETTERS = re.compile(r"[^\W\d_]{3,20}")

#: Frequent words in passwords, most frequent first; the rank is the number of guesses.
COMMON = (
    "password passwd pass admin root user login guest test demo secret token key master welcome default changeme "
    "letmein dragon monkey qwerty iloveyou sunshine princess football baseball shadow superman trustno hello freedom "
    "whatever michael jordan hunter ranger buster soccer hockey killer george andrew charlie thomas summer winter "
    "spring autumn monday friday january april july october apple orange banana coffee computer internet server "
    "service system network example sample public private account email mail home love money god angel star blue red "
    "green black white the and for you with this that from your not null none true false value string text word"
).split()
#: Keyboard rows.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
PLAIN = str.maketrans("@4310$57", "aaeiosst")
DATE = re.compile(r"(?:19|20)\d{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d{2}")


def _walks(low: str, i: int) -> int:
    """The length of the longest run from i along a keyboard row or a sequence, either way."""
    best = 1
    for row in ROWS:
        at = row.find(low[i])
        for step in (1, -1):
            k, j = at, i
            while k >= 0 and j + 1 < len(low) and 0 <= k + step < len(row) and row[k + step] == low[j + 1]:
                k, j = k + step, j + 1
            best = max(best, j - i + 1)
    return best


def values(text: str) -> list[tuple[int, int]]:
    """Where values stand in a credential context: a quoted one whole, another without closing punctuation."""
    out = []
    low = text.lower()
    if any(w in low for w in CONTEXT_WORDS):
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            while m.lastindex > QUOTED and end > start and text[end - 1] in CLOSING:
                end -= 1
            if end - start >= 6:
                out.append((start, end))
    return out


def without_values(text: str) -> str:
    """The text without the values in credential contexts and base assignments."""
    low = text.lower()
    if not any(w in low for w in CONTEXT_WORDS):
        return text
    spans = sorted(values(text) + [m.span(2) for m in ASSIGN.finditer(text)])
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = max(at, end)
    return " ".join([*out, text[at:]])


def word_counts(docs: DataFrame, most: int = DICTIONARY, least: int = IN_DOCUMENTS) -> list[str]:
    """The words (3 to 20 letters, lower-cased) that stand in at least `least` documents, by how many documents hold
    them, the most frequent `most` or somewhat fewer (words of nearly one frequency go in together). What stands where a
    credential's value would is no word, so a secret that many documents repeat isn't made cheap by that. Counted over all
    documents and summed in each task before they are shuffled."""

    def count(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for text in texts(batch):
                total.update(set(LETTERS.findall(without_values(text or "").lower())))
                if len(total) > HELD_WORDS:
                    yield pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
                    total = Counter()
        yield pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    counts = id_text(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    known = stored(counts.filter(F.col("n") >= least), "words")
    left, cut = most, None  # the count from which on there is room; counts are binned, so that few rows come to the driver
    for r in known.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("n")).orderBy(F.desc("b")).collect():
        left -= r["c"]
        if left < 0:
            break
        cut = r["n"]
    if cut is None:
        return []
    return [w for _, w in sorted((-r["n"], r["word"]) for r in known.filter(F.col("n") >= cut).collect())]


class Guesser:
    """log10 of the guesses that a value needs, under a dictionary (most frequent words first)."""

    def __init__(self, words: Sequence[str] = ()):
        self.rank: dict[str, int] = {}
        for known in (COMMON, words):
            for k, w in enumerate(known):
                self.rank[w] = min(k + 1, self.rank.get(w, k + 1))
        self.longest = max(map(len, self.rank))
        self.seen: dict[str, float] = {}

    def __call__(self, value: str, enough: float = math.inf) -> float:
        """The cheapest segmentation of `value`, or some number from `enough` on if that many are needed."""
        if len(value) > LONG:
            return self._cost(value, enough)
        found = self.seen.get(value)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.seen[value] = self._cost(value, math.inf)
        return found

    def word(self, value: str, low: str, plain: str) -> float | None:
        """A dictionary word, its leetspeak (a factor of 3) or its capitals (2, or 2 a letter if they are mixed)."""
        for form, extra in ((low, 0.0), (plain, 0.5)):
            if form in self.rank:
                upper = 0.0 if value == low else math.log10(2) * (1 if value.istitle() or value.isupper() else len(value))
                return math.log10(self.rank[form] + 1) + extra + upper
        return None

    def _cost(self, value: str, enough: float) -> float:
        """best[j] is the cheapest cost of the first j characters; each span that ends at j adds its own cost, and every
        span after the first a factor of 2 for order. Spans of one repeated character are at most LONG characters or reach
        its end; brute force over more than LONG characters goes by a running minimum. So a long value takes time in its
        length."""
        low = value.lower() if len(value.lower()) == len(value) else value
        plain = low.translate(PLAIN)
        n = len(value)
        spans: dict[int, list[tuple[int, float]]] = {}  # by end: start, cost
        best, far, begin, run = [0.0] * (n + 1), math.inf, 0, 0
        for j in range(n + 1):
            if j:
                best[j] = far + j
                for i in range(max(0, j - LONG), j):  # brute force: 10 guesses a character
                    best[j] = min(best[j], best[i] + (j - i) * 1.0 + (ORDER if i else 0.0))
                for i, own in spans.pop(j, ()):
                    best[j] = min(best[j], best[i] + own + (ORDER if i else 0.0))
                if j >= LONG:
                    i = j - LONG
                    far = min(far, best[i] + (ORDER if i else 0.0) - i)
                    # every way to the end stops in the last LONG places, or costs more than LONG, or repeats one character over them
                    if enough <= LONG and begin > i and min(best[i + 1 : j + 1]) >= enough:
                        return min(best[i + 1 : j + 1])
            if j == n:
                break
            for k in range(j + 3, min(n, j + self.longest) + 1):
                own = self.word(value[j:k], low[j:k], plain[j:k])
                if own is not None:
                    spans.setdefault(k, []).append((j, own))
            if value[j].isdigit():
                for k in range(j + 4, min(n, j + 10) + 1):
                    if DATE.fullmatch(value, j, k):
                        spans.setdefault(k, []).append((j, math.log10(120) + (math.log10(365) if k - j > 4 else 0)))
            if run <= j:
                begin, run = j, j + 1
                while run < n and low[run] == low[j]:
                    run += 1
            for k in {*range(j + 2, min(run, j + LONG) + 1), *([run] if run > j + 1 else [])}:
                spans.setdefault(k, []).append((j, 1.0 + math.log10(k - j)))
            for k in range(3, _walks(low, j) + 1):
                spans.setdefault(j + k, []).append((j, math.log10(40) + math.log10(k)))
        return best[n]


guess_cost = Guesser()


def scan(text: str, min_log10: float = MIN_LOG10, guesser: Guesser = guess_cost) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start and then kind."""
    low = text.lower()
    found: list[tuple[str, int, int]] = []
    if any(w in low for w in CONTEXT_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        taken = [(a, b) for _, a, b in found]
        for start, end in values(text):
            if not any(a <= start and end <= b for a, b in taken) and guesser(text[start:end], min_log10) >= min_log10:
                found.append(("guess", start, end))
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _shared_guesser(docs: DataFrame, words: Sequence[str] | None) -> Callable[[], Guesser]:
    """A dictionary counted from `docs` (or given), broadcast; each Python worker builds it once."""
    shared, name = docs.sparkSession.sparkContext.broadcast(word_counts(docs) if words is None else list(words)), uuid.uuid4().hex
    return lambda: held(name, lambda: Guesser(shared.value))


def secret_spans(docs: DataFrame, min_log10: float = MIN_LOG10, words: Sequence[str] | None = None) -> DataFrame:
    """doc_id and the spans of every document, as an array of (kind, start, end). words: the dictionary, counted from the
    documents if none is given. No text is shuffled."""
    guesser = _shared_guesser(docs, words)
    schema = "doc_id long, found array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = guesser()
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in scan(t or "", min_log10, own)] for t in texts(batch)]
        return pa.record_batch([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

    return arrow_map(id_text(docs), run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", min_log10: float = MIN_LOG10, words: Sequence[str] | None = None) -> DataFrame:
    """`docs` with every found span of `text` replaced by `mark`; other columns stay, rows stay. `n_chars`, where there
    is one, follows the text. Overlapping spans are replaced as one. words: as in secret_spans."""
    guesser = _shared_guesser(docs, words)

    def one(text: str | None, own: Guesser) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, start, end in scan(text, min_log10, own):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    def run(batches):
        own = guesser()
        for batch in slices(batches):
            masked = pa.array([one(t, own) for t in texts(batch)], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", masked)

    names = docs.columns
    typed = docs.withColumn("text", F.col("text").cast("string"))
    out = typed.mapInArrow(run, typed.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from `secret_spans`."""
    item = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    joined = lambda col: F.array_join(F.transform(col, item), ",")
    return spans.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("found", lambda x: x["kind"] != "guess")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
    )


__all__ = ["Guesser", "digest", "guess_cost", "redact", "scan", "secret_spans", "word_counts"]
