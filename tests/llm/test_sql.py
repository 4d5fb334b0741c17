"""Registered corpus queries against their SQL, and all of them over the smallest tables."""

import duckdb
import pytest

from photonlake.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    got = QUERIES[name](spark, small).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_one_row_a_document_or_more(spark, small, name):
    if name == "op12_conversation_repair":
        conversations = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct()
        assert QUERIES[name](spark, small).count() == conversations.count()
        return
    out = QUERIES[name](spark, small)
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    found = out.select("doc_id").distinct().count()
    assert found == n or (name == "op9_decontamination" and 0 < found < n)
