"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that hold a benchmark
item go, secrets are masked, and what is left is packed into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of `documents`, and any
others, whatever their names. Each judges what the stage before it kept. What a row's text alone decides is decided beside
the row; near duplicates compare keys, and shuffle the texts once to meet the list of what goes.

Null texts and texts without words are scored like any text without known words, are one near-duplicate group (one row of
them stays), hold no item and no secret, and pack as the end id alone. Repeated rows are near duplicates. Rows without a
doc_id pass the near-duplicate stage. Very long texts are read whole. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from photonlake.llm import decontaminate, packing, secrets, simhash, toxicity
from photonlake.llm.common import dropped, stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("secrets", mask_secrets), ("packing", pack)]

#: SQL can't express the classifier, the tokenizer and the packing; tests compare the pipeline with its stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet in the shared folder and read again, and removed when
    the next one is written."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if old is not None:
            dropped(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
