"""Nearest neighbours by randomly rotated one-bit codes.

Every vector is centred, scaled to length 1, lifted to `code_bits` dimensions by a random matrix with orthonormal
columns, and kept as the signs of the result (packed), its length and the inner product f of signs and unit vector. The
inner product with a query is then estimated from the signs alone: <q, signs> / f, with an error of at most
eps * |q| * sqrt((1 - f^2) / f^2 / (code_bits - 1)) with high probability.

Queries and codes are dealt out in blocks; every block of queries meets every block of codes, which is what a stated query
set against all rows means. They meet twice. First each pair gives the k best lower bounds of its queries, and the k-th best
of all pairs is a query's line. Then the candidates whose upper bound reaches the line are chosen. Only those are joined
with their vectors and ranked exactly, in double precision.

Left out: vectors that are null, empty, zero or hold null or non-finite components, and vectors whose length isn't the
most frequent one (ties: the longer). Bounds are taken on vectors that are scaled by the largest component of all, so large
finite vectors take part; a score that is too large for a double is infinite. Equal scores go to the smaller key. A query's
own key is no candidate. Repeated rows are candidates each, and repeated queries give k rows each. An empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonlake.llm.common import stored

CODE_BITS = 512
EPS = 3.0
BLOCK = 8192
QUERY_BLOCK = 512


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vec (array<double>) of the vectors that take part."""
    df = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).filter(finite & F.exists("vec", lambda x: x != 0))


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """bits x dim with orthonormal columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((max(bits, dim), dim)))
    return q * np.sign(np.diag(r))


def normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 (zero rows stay) and lengths, without squares of very large or small numbers."""
    most = np.abs(x).max(1, initial=0)
    unit = x / np.where(most > 0, most, 1)[:, None]
    length = np.sqrt((unit**2).sum(1))
    return unit / np.where(length > 0, length, 1)[:, None], most * length


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and correction scalars f of the rows of x."""
    unit, length = normalised(x - centre)
    lifted = unit @ turn.T
    signs = lifted > 0
    f = np.abs(lifted).sum(1) / math.sqrt(turn.shape[0])
    return np.packbits(signs, axis=1), length, np.where(length > 0, f, 1.0)


def estimate(codes: np.ndarray, length: np.ndarray, f: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (candidates x queries) and their error bounds."""
    bits = turn.shape[0]
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
    turned = (queries @ turn.T / math.sqrt(bits)).astype(np.float32)
    about = (signs @ turned.T).astype(float) * (length / f)[:, None] + (queries @ centre)[None, :]
    size = np.sqrt((queries**2).sum(1))[None, :]
    bound = (length * np.sqrt(np.maximum(1 - f**2, 0)) / f)[:, None] * size * (eps / math.sqrt(max(bits - 1, 1)))
    bound += (1e-5 * length[:, None] + 1e-12 * np.sqrt((centre**2).sum())) * size  # rounding
    return about, bound


def matrix(frame: pa.RecordBatch | pa.Table, dim: int) -> np.ndarray:
    column = frame.column("vec")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", code_bits: int = CODE_BITS, eps: float = EPS, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that `is_query` (over vec_id) marks, the k nearest found."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    largest = F.max(F.array_max(F.transform("vec", F.abs)))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("asked"), largest.alias("largest")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, largest = int(sizes["dim"]), int(sizes["n"]), float(sizes["largest"])
    rows = stored(rows.filter(F.size("vec") == dim).withColumn("row", F.monotonically_increasing_id()), "vectors")
    scaled = rows.withColumn("vec", F.transform("vec", lambda x: x / largest))  # so no square overflows

    def sums(batches):
        total = np.zeros(dim)
        for b in batches:
            total += matrix(b, dim).sum(0)
        yield pa.record_batch([pa.array(range(dim), pa.int32()), pa.array(total)], ["d", "s"])

    centre = np.zeros(dim)
    for r in scaled.select("vec").mapInArrow(sums, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect():  # dim rows
        centre[r["d"]] = r["s"] / n
    blocks, query_blocks = -(-n // block), max(1, -(-int(sizes["asked"]) // QUERY_BLOCK))
    shared = spark.sparkContext.broadcast((centre, rotation(dim, max(code_bits, dim), seed)))

    def index(key_: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        """One row for each block: its keys, codes and scalars."""
        codes, length, f = encode(matrix(frame, dim), *shared.value)
        data = [frame.column("row").to_numpy().tobytes(), frame.column("vec_id").to_numpy().tobytes(), codes.tobytes(), length.tobytes(), f.tobytes()]
        return pa.table([pa.array([key_[0].as_py()], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], ["b", "rows", "ids", "codes", "length", "f"])

    def gather(key_: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        x, _ = normalised(matrix(frame, dim))
        data = [frame.column("row").to_numpy().tobytes(), frame.column("vec_id").to_numpy().tobytes(), frame.column("line").to_numpy().tobytes(), x.tobytes()]
        return pa.table([pa.array([key_[0].as_py()], pa.int32()), *(pa.array([d], pa.binary()) for d in data)], ["qb", "qrows", "qids", "lines", "qx"])

    dealt = lambda m, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m)).cast("int")
    candidates = stored(scaled.groupBy(dealt(blocks, 1).alias("b")).applyInArrow(index, "b int, rows binary, ids binary, codes binary, length binary, f binary"), "codes")
    queries = scaled.filter(is_query)

    def met(lines: DataFrame, look, schema: str) -> DataFrame:
        """Every block of queries with every block of codes."""
        own = lines.groupBy(dealt(query_blocks, 2).alias("qb")).applyInArrow(gather, "qb int, qrows binary, qids binary, lines binary, qx binary")
        pairs = own.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(candidates, "b")

        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    r = {c: batch.column(c)[at].as_py() for c in ("qrows", "qids", "lines", "qx", "rows", "ids", "codes", "length", "f")}
                    ids, qids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["qids"], "<i8")
                    codes = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1)
                    about, bound = estimate(codes, np.frombuffer(r["length"]), np.frombuffer(r["f"]), np.frombuffer(r["qx"]).reshape(-1, dim), *shared.value, eps)
                    about[ids[:, None] == qids[None, :]] = -np.inf
                    yield look(np.frombuffer(r["qrows"], "<i8"), np.frombuffer(r["lines"]), np.frombuffer(r["rows"], "<i8"), about, bound)

        return pairs.drop("b", "qb").mapInArrow(run, schema)

    def lows(qrows, lines, ids, about, bound):
        """The k best lower bounds of every query in this block."""
        m = min(k, len(ids))
        low = np.partition(about - bound, len(ids) - m, axis=0)[len(ids) - m :]
        return pa.record_batch([pa.array(np.repeat(qrows, m)), pa.array(low.T.ravel())], ["row", "low"])

    def survivors(qrows, lines, ids, about, bound):
        at, q = ((about + bound >= lines[None, :]) & np.isfinite(about)).nonzero()
        return pa.record_batch([pa.array(qrows[q]), pa.array(ids[at])], ["qrow", "row"])

    best_low = Window.partitionBy("row").orderBy(F.desc("low"))
    lines = met(queries.withColumn("line", F.lit(0.0)), lows, "row long, low double").withColumn("r", F.row_number().over(best_low)).filter(F.col("r") == k)
    lines = queries.join(lines.select("row", F.col("low").alias("line")), "row", "left").withColumn("line", F.coalesce("line", F.lit(-math.inf)))
    chosen = met(lines, survivors, "qrow long, row long")
    found = chosen.join(rows, "row").select("qrow", "vec_id", "vec").join(rows.select(F.col("row").alias("qrow"), F.col("vec_id").alias("query_id"), F.col("vec").alias("q")), "qrow")
    score = F.aggregate(F.zip_with("q", "vec", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)  # from the first component to the last
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), "vec_id")
    return found.select("qrow", "query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
