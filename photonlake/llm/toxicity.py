"""Toxicity by a noisy channel: deobfuscate words by a Viterbi search, then score the restored text.

Channel: a written character stands for itself, for the letters that leetspeak writes that way, for nothing (a separator
inside a word, or a repetition of the character before it), or for any letter if it is a mask. Source: a character
trigram model counted over all documents. The decoder finds the cheapest letter string through the lattice; state is
the last two letters. Words of letters without a character three times in a row have a lattice of one path and pass as
they are. Every other token is decoded, whatever its length and share of letters; runs of one character are shortened to
four first. Symbols around a word may be letters of it or go at little cost. Runs of three or more single characters are
joined ("i d i o t"), and the lattice may put gaps between words there and at separators.

Score: logistic regression on how often restored words and their first 4, 5 and 6 letters stand in a text, over those
features that the labelled sample ties to either label (chi-square). The sample is bounded by `fit_rows`; the language
model reads all documents.

Null and empty texts get the score of a text without features. Without labelled rows, or with one label only, every
score is the smoothed share of label 1. Rows whose label is null aren't learned from.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import arrow_map, bounded_sample, held, id_text, kept_rows, stored, texts

FIT_ROWS = 8_000
MAX_FEATURES = 1_500
MAX_LATTICE, BEAM = 32, 64
SYMBOLS = 28  # the gap between words, a to z, any other letter
OTHER = 27
#: What leetspeak may write for a letter.
LEET = {"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "1": "il", "!": "i", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
MASKS = "*#?"
SEPARATORS = ".-_~'*,/\\:"
COST_SELF, COST_LEET, COST_MASK, COST_DROP, COST_REPEAT, COST_KEEP = 0.05, 1.0, 3.0, 0.7, 0.7, 6.0
COST_EDGE, COST_GAP = 0.7, 1.5
#: What stands around a word: opening marks; closing punctuation and all after it; trailing masks; a symbol three times.
EDGE = re.compile(r"^\W+(?=\w)|(?:[,.;:!?\"')\]|][\W_]*|[#*%&]+|(\W)\1\1+)$")
TRIPLE = re.compile(r"(.)\1\1")
LONG_RUN = re.compile(r"(.)\1{4,}")
SPACED = re.compile(r"(?<!\S)(?:\S\s{1,3}){2,}\S(?!\S)")
TABLE = 0x250


def _symbols() -> np.ndarray:
    import unicodedata

    out = np.zeros(TABLE, np.int64)
    for c in range(TABLE):
        base = unicodedata.normalize("NFKD", chr(c).lower())[0]
        if chr(c).isalpha():
            out[c] = ord(base) - 96 if "a" <= base <= "z" else OTHER
    return out


_SYMBOL = _symbols()


def symbol(c: str) -> int:
    return int(_SYMBOL[ord(c)]) if ord(c) < TABLE else OTHER if c.isalpha() else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts. Each task sums its own rows; at most 28^3 sums reach the driver."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in texts(batch):
                if text:
                    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                    s = np.r_[0, 0, np.where(points < TABLE, _SYMBOL[np.minimum(points, TABLE - 1)], OTHER), 0]
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = total.nonzero()[0]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    found = id_text(docs).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**3)
    out[found["gram"].to_numpy(int)] = found["n"]
    return out


def trigram_costs(counts: np.ndarray) -> list[float]:
    """-ln P(c | a, b), smoothed by the bigram and unigram models."""
    n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = (n.sum((0, 1)) + 1) / (n.sum() + SYMBOLS)
    two = (n.sum(0) + 5 * one) / (n.sum(0).sum(1, keepdims=True) + 5)
    three = (n + 5 * two) / (n.sum(2, keepdims=True) + 5)
    return (-np.log(three)).ravel().tolist()


def decode(token: str, costs: list[float]) -> str:
    """The cheapest letters for a token."""
    return cheapest(token, costs)[1]


def cheapest(token: str, costs: list[float], edges: frozenset[int] = frozenset(), gaps: bool = False, spaced: bool = False, most: float = math.inf) -> tuple[float, str]:
    """The cost and letters of the cheapest way through a token's lattice, which is known to cost at most `most`. A candidate's letters extend the state; dropping a character keeps it. Characters
    at `edges` may go at little cost, `gaps` lets a separator be the gap between two words, and `spaced` lets a gap stand
    before any character. Behind `MAX_LATTICE` characters the `BEAM` cheapest states go on."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    before = ""
    for k, c in enumerate(token):
        if c.isalpha():
            options = [(COST_SELF, c, symbol(c))]
        else:
            options = [(COST_LEET, x, ord(x) - 96) for x in LEET.get(c, "")]
            if c in MASKS:
                options += [(COST_MASK, chr(96 + k), k) for k in range(1, 27)]
        drop = COST_EDGE if k in edges else COST_REPEAT if c == before else COST_DROP if c in SEPARATORS else COST_KEEP if not options else math.inf
        if spaced and k:
            for (a, b), (cost, text) in list(best.items()):
                total = cost + costs[(a * SYMBOLS + b) * SYMBOLS]
                if b and total < best.get((b, 0), (math.inf,))[0]:
                    best[b, 0] = (total, (text, " "))
        if gaps and k not in edges and c in SEPARATORS:
            options = [*options, (COST_GAP, " ", 0)]
        nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, text) in best.items():
            if drop < math.inf and cost + drop < nxt.get((a, b), (math.inf,))[0]:
                nxt[a, b] = (cost + drop, text)
            for own, x, s in options:
                total = cost + own + costs[(a * SYMBOLS + b) * SYMBOLS + s]
                if total <= most and total < nxt.get((b, s), (math.inf,))[0]:
                    nxt[b, s] = (total, (text, x))
        if k >= MAX_LATTICE and len(nxt) > BEAM:
            nxt = dict(sorted(nxt.items(), key=lambda x: x[1][0])[:BEAM])
        best, before = nxt, c
    ends = [(cost + costs[(a * SYMBOLS + b) * SYMBOLS], text) for (a, b), (cost, text) in best.items()]
    least = min(cost for cost, _ in ends)
    return least, min(_joined(text) for cost, text in ends if cost == least)


def _joined(text: tuple) -> str:
    out = []
    while text:
        text, x = text
        out.append(x)
    return "".join(reversed(out))


class Spaced(str):
    """Letters that stood with single spaces between them; some of those may have been borders of words."""


def restored(token: str, costs: list[float]) -> str:
    """A lower-case token as a word, or as several with spaces between them."""
    spaced = isinstance(token, Spaced)
    if token.isalpha() and not spaced and not TRIPLE.search(token):
        return token
    token = LONG_RUN.sub(r"\1\1\1\1", token)
    at, core = 0, token
    if m := EDGE.search(core):
        at, core = (m.end(), core[m.end() :]) if m.start() == 0 and m.end() < len(core) else (0, core[: m.start()])
    core = EDGE.sub("", core)
    marks = lambda part: "".join(c for c in part if c in LEET or c in MASKS)  # noqa: E731  (others can only go)
    front, back = marks(token[:at]), marks(token[at + len(core) :])
    if not front and not back and core.isalpha() and not spaced and not TRIPLE.search(core):
        return core
    whole = front + core + back
    edges = frozenset([*range(len(front)), *range(len(front) + len(core), len(whole))])
    bound = cheapest(core, costs, frozenset(), True, spaced)[0] + COST_EDGE * len(edges) + 1e-9  # the way that drops all edges
    return " ".join(cheapest(whole, costs, edges, True, spaced, bound)[1].split())


def tokens(text: str) -> list[str]:
    """Words; runs of single characters with spaces between them are one `Spaced` word."""
    low, out, at = text.lower(), [], 0
    for m in SPACED.finditer(low):
        out += low[at : m.start()].split()
        out.append(Spaced("".join(m[0].split())))
        at = m.end()
    return out + low[at:].split()


def features(word: str) -> tuple[int, ...]:
    """Hashes of the word and of its first letters."""
    if not word:
        return ()
    return tuple(xxhash.xxh64_intdigest(part) >> 1 for part in (f"={word}", *(word[:k] for k in (4, 5, 6) if len(word) >= k)))


def _token_features(texts_: list[str | None], costs: list[float]):
    """For each text its features and their counts."""
    seen: dict[tuple[str, bool], tuple[int, ...]] = {}
    for text in texts_:
        found: list[int] = []
        for t in tokens(text or ""):
            key = (t, isinstance(t, Spaced))
            if key not in seen:
                seen[key] = tuple(f for word in restored(t, costs).split() for f in features(word))
            found += seen[key]
        yield np.unique(np.array(found, np.int64), return_counts=True)


def feature_frequencies(sample: DataFrame, costs: list[float]) -> DataFrame:
    """feature, n (texts with it), n1 (of label 1); every batch is summed before it is shuffled."""
    shared = sample.sparkSession.sparkContext.broadcast(costs)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        label = batch.column("toxic").to_numpy()
        found = [f for f, _ in _token_features(texts(batch), shared.value)]
        names, at = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_inverse=True)
        ones = np.bincount(at, np.repeat(label, [len(f) for f in found]), len(names)).astype(np.int64)
        return pa.record_batch([pa.array(names), pa.array(np.bincount(at, minlength=len(names))), pa.array(ones)], ["feature", "n", "n1"])

    return arrow_map(sample.select("text", "toxic"), run, "feature long, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))


def chosen_features(frequencies: DataFrame, d: int, d1: int) -> list[int]:
    """Those that chi-square ties to a label, at most MAX_FEATURES."""
    gap = F.col("n1") * F.lit(float(d - d1)) - (F.col("n") - F.col("n1")) * F.lit(float(d1))
    chi = gap * gap * d / (F.lit(float(d1) * (d - d1)) * F.col("n") * (d - F.col("n")))
    kept = frequencies.filter((F.col("n") >= 3) & (F.col("n") < d)).withColumn("chi", chi).filter("chi > 12")
    return [r["feature"] for r in kept.orderBy(F.desc("chi"), "feature").limit(MAX_FEATURES).collect()]


def feature_matrix(sample: DataFrame, costs: list[float], chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """log(1 + count) of the chosen features in the rows of a bounded sample, with a last column of ones, and their labels."""
    names = np.sort(np.array(chosen, np.int64))
    shared = sample.sparkSession.sparkContext.broadcast((costs, names))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        costs, names = shared.value
        at, counts = [], []
        for f, n in _token_features(texts(batch), costs):
            _, k, own = np.intersect1d(names, f, assume_unique=True, return_indices=True)
            at.append(k.astype(np.int32).tobytes())
            counts.append(n[own].astype(np.float32).tobytes())
        return pa.record_batch([batch.column("toxic"), pa.array(at, pa.binary()), pa.array(counts, pa.binary())], ["toxic", "at", "counts"])

    rows = arrow_map(sample.select("text", "toxic"), run, "toxic int, at binary, counts binary").collect()
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], np.int32)] = np.log1p(np.frombuffer(r["counts"], np.float32))
    return x, np.array([r["toxic"] for r in rows], float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method, a part of the rows at a time; the last column of x is all ones, and its
    weight isn't shrunk."""
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(steps):
        h, slope = np.diag(shrink), -shrink * w
        for at in range(0, len(x), 1000):  # all of x as doubles would be the most that the driver holds
            own = x[at : at + 1000].astype(float)
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            slope += own.T @ (y[at : at + 1000] - p)
            own *= np.sqrt(p * (1 - p) + 1e-6)[:, None]
            h += own.T @ own
        step = np.linalg.solve(h, slope)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """`docs`: all documents, for the language model. `labels`: doc_id and toxic of rows to learn from. The labels are
    sampled before they meet the texts, so at most about `fit_rows` labels are broadcast."""
    costs = trigram_costs(trigram_counts(docs))
    own = bounded_sample(labels, "doc_id", labels.count(), fit_rows, 7)
    sample = stored(id_text(docs).join(F.broadcast(own), "doc_id").select("text", "toxic"), "labelled")
    d, d1 = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = (d1 + 0.5) / (d + 1)
    model = {"costs": costs, "weights": {}, "base": math.log(share / (1 - share))}
    chosen = chosen_features(feature_frequencies(sample, costs), d, d1) if 0 < d1 < d else []
    if not chosen:
        return model
    w = logistic(*feature_matrix(sample, costs, chosen))
    return model | {"weights": {int(f): float(v) for f, v in zip(sorted(chosen), w[:-1], strict=True)}, "base": float(w[-1])}


#: Tokens whose features a scorer remembers.
REMEMBERED = 250_000


class Scorer:
    """Scores texts under a model and remembers, within a bound, which features a token has."""

    def __init__(self, model: dict):
        self.model, self.seen = model, {}

    def __call__(self, text: str | None) -> float:
        weights, costs, seen = self.model["weights"], self.model["costs"], self.seen
        found: dict[int, int] = {}
        for t in tokens(text or ""):
            key = (t, isinstance(t, Spaced))
            hits = seen.get(key)
            if hits is None:
                if len(seen) > REMEMBERED:
                    seen.clear()
                hits = seen[key] = tuple(f for word in restored(t, costs).split() for f in features(word) if f in weights)
            for f in hits:
                found[f] = found.get(f, 0) + 1
        z = self.model["base"] + sum(weights[f] * math.log1p(n) for f, n in sorted(found.items()))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _scorer(name: str, shared) -> Scorer:
    """One for each Python worker and model."""
    return held(name, lambda: Scorer(shared.value))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row; the text alone decides. No shuffle."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        scorer = _scorer(name, shared)
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(scorer, texts(batch)), pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def learnable(labels: DataFrame, modulus: int = 5, fold: int = 0) -> DataFrame:
    """doc_id and toxic of the labels outside the fold. Repeated labels of a document: the largest holds."""
    own = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % modulus != fold))
    return own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def held_out_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query."""
    out = score(docs, fit(docs, learnable(labels)))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose score reaches the threshold; columns stay. The score is computed beside the row,
    so nothing is joined back."""
    model = fit(docs, learnable(labels))
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def mild(texts_: list[str | None]) -> np.ndarray:
        scorer = _scorer(name, shared)
        return np.array([scorer(text) < threshold for text in texts_], bool)

    return kept_rows(docs, mild)
