"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizer files lie unless a caller names another folder.
TOKENIZER_DIR = "/opt/tokenizers"
SLICE_BYTES = 8 << 20  # of text that a task looks at together


def vocabulary_path(name: str) -> str:
    """The place of a tokenizer file of the installed package, or of TOKENIZER_DIR without it."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZER_DIR}/{name}"
    return str(public_tokenizers.path(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets a new
    temporary folder; on a cluster, whose executors couldn't see one, it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes `df` as Parquet into the shared folder and reads it back, so a lost executor costs
    a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes what `stored` wrote for `df`, which nothing may read any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text, under the names doc_id and text; other columns can't clash any more."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (a longer text alone), so memory doesn't follow the batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def kept_rows(docs: DataFrame, keep: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """The rows whose texts `keep` marks, judged beside the row and about SLICE_BYTES of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(keep(batch.column("text").cast(pa.string()).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_HELD: dict[str, object] = {}


def held(name: str, build: Callable[[], object]) -> object:
    """What `build` makes, once in each Python worker, which keeps it from task to task until another name is asked for. A worker
    serves one stage after the other and holds the tables of one."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = build()
    return _HELD[name]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def bounded_fraction(n: int, bound: int) -> float:
    return 1.0 if n <= bound else bound / n


def bounded_sample(df: DataFrame, key: str, n: int, bound: int, salt: int) -> DataFrame:
    """About `bound` of `n` rows, chosen by a hash of the key, so every run chooses the same."""
    if n <= bound:
        return df
    cut = int(bounded_fraction(n, bound) * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 30)) < cut)
