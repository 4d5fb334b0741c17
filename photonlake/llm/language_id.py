"""Language identification by error-correcting output codes.

Every language gets a codeword; every bit of it has a binary classifier over hashed character n-grams (1 to 4 letters),
a naive-Bayes log-odds between the languages whose bit is 1 and those whose bit is 0. A text's margins are compared with
every codeword by a margin-weighted logistic loss, so a weak bit counts little, and the codeword of least loss wins.
`ambiguous` is set where the runner-up is closer than `min_gap`.

Fitting reads a bounded sample of labelled rows (`fit_rows`, chosen by a hash of doc_id); n-gram counts and the sums over
languages stay in the executors, and only the languages' totals and buckets x bits weights come to the driver. Prediction
reads every whole text.

Null texts and texts without letters give `und`, score 0; emoji, digits and punctuation of any script are no letters. Without
any labelled row every text gives `und`. Rows without a language don't take part in fitting. With one language only, every
text with letters gets it, score 1. Repeated rows count each in fitting and are predicted each; a very long text weighs by
its length in fitting and is read whole.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import arrow_map, bounded_sample, mixed, stored, texts

BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
FIT_ROWS = 20_000
SHARPNESS = 10.0
#: Languages whose counts a task holds at once.
HELD = 64
_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str) -> np.ndarray:
    """Code points of the letters (Unicode categories L*) of the lower-cased text, every run of other characters as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _LETTER[points]
    points = np.where(keep, points, 0).astype(np.uint64)
    return points[keep | np.r_[True, keep[:-1]]]


def buckets(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in the text; all zero if it has no letters."""
    points = letters(text)
    if not points.any():
        return np.zeros(BUCKETS, np.int64)
    points = np.r_[np.uint64(0), points, np.uint64(0)]
    total, code = np.zeros(BUCKETS, np.int64), np.zeros(len(points), np.uint64)
    for k in ORDERS:
        code = (code[:-1] if k > 1 else code) * np.uint64(0x9E3779B97F4A7C15) + points[k - 1 :] + np.uint64(1)
        if len(code):
            total += np.bincount((mixed(code) >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)
    return total


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits of up to 5 languages, else random balanced splits, every pair of languages
    told apart by many bits."""
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T.reshape(n, -1)
    rng = np.random.default_rng(7)
    half = np.r_[np.ones(n // 2), -np.ones(n - n // 2)]
    return np.stack([rng.permutation(half) for _ in range(int(np.ceil(15 * np.log2(n))))], 1)


def language_counts(sample: DataFrame) -> DataFrame:
    """lang, bucket, n: n-gram counts, summed over the rows of a task before they are shuffled."""

    def packed(total):
        for lang, n in total.items():
            at = n.nonzero()[0]
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
                if text:
                    if lang not in total and len(total) >= HELD:
                        yield from packed(total)
                        total = {}
                    total[lang] = total.get(lang, 0) + buckets(text)
        yield from packed(total)

    return sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def bit_weights(counts: DataFrame, names: list[str], totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """buckets x bits log-odds, summed over languages in the executors."""
    smooth = 0.5 / (totals + 0.5 * BUCKETS)
    base = [np.where(code == sign, smooth[:, None], 0).sum(0) for sign in (1, -1)]
    size = [(code == sign).sum(0) for sign in (1, -1)]
    odds = lambda plus, minus: np.log((base[0] + plus) / size[0]) - np.log((base[1] + minus) / size[1])
    shared = counts.sparkSession.sparkContext.broadcast((np.array(names), totals, code))

    def weigh(_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, totals, code = shared.value
        at = np.searchsorted(names, np.array(table.column("lang").to_pylist()))
        share = table.column("n").to_numpy() / (totals[at] + 0.5 * BUCKETS)
        bucket, own = np.unique(table.column("bucket").to_numpy(), return_inverse=True)
        sums = np.zeros((2, len(bucket), code.shape[1]))
        for part in np.split(np.arange(len(own)), range(4096, len(own), 4096)):
            for k, sign in enumerate((1, -1)):
                np.add.at(sums[k], own[part], share[part, None] * (code[at[part]] == sign))
        weights = odds(*sums).astype(np.float32)
        return pa.table([pa.array(bucket), pa.array([w.tobytes() for w in weights], pa.binary())], ["bucket", "weights"])

    out = np.repeat(odds(0, 0).astype(np.float32)[None], BUCKETS, 0)
    for r in counts.groupBy(F.col("bucket") % 64).applyInArrow(weigh, "bucket long, weights binary").toLocalIterator():
        out[r["bucket"]] = np.frombuffer(r["weights"], np.float32)
    return out


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """The classifiers of all bits. `docs`: doc_id, text and lang of the rows that may be learned from."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(rows, "doc_id", rows.count(), fit_rows, 6).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = stored(language_counts(sample), "grams")
    found = sorted((r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())
    if not found:
        return None
    names, totals = [x for x, _ in found], np.array([n for _, n in found], float)
    code = codewords(len(names))
    return {"names": names, "code": code, "weights": bit_weights(counts, names, totals, code) if code.size else np.zeros((BUCKETS, 0), np.float32)}


def predict(docs: DataFrame, model: dict | None, min_gap: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every row; the text alone decides."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = broadcast.value
        out = []
        for text in texts(batch):
            n = buckets(text) if text and m else np.zeros(0)
            if not n.any():
                out.append(("und", 0.0, True))
                continue
            names = m["names"]
            if len(names) == 1:
                out.append((names[0], 1.0, False))
                continue
            at = n.nonzero()[0]
            margin = SHARPNESS * (n[at] @ m["weights"][at]) / n.sum()  # a mean, so that length doesn't decide how sure it is
            loss = np.logaddexp(0, -m["code"] * margin).sum(1)
            odds = np.exp(loss.min() - loss)
            first = int(loss.argmin())
            second = np.partition(loss, 1)[1]
            out.append((names[first], float(odds[first] / odds.sum()), bool(second - loss[first] < min_gap)))
        return pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out_query(docs: DataFrame, modulus: int = 4, fold: int = 2) -> DataFrame:
    """The contract's query: learn from the rows outside the fold, predict all."""
    rest = F.crc32(F.col("doc_id").cast("string")) % modulus
    model = fit(docs.filter(rest != fold).select("doc_id", "text", "lang"))
    return predict(docs, model).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == fold, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
