"""Every query with SQL gives the rows of its SQL; the others give rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from photonlake.plans.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Packets of a 12-bit clock need denser events than the smallest tables have.
LARGER = {"evt3_packet_roundtrip"}


@pytest.fixture(scope="module")
def duck():
    cache = {}

    def of(folder):
        if folder not in cache:
            con = duckdb.connect()
            for t in TABLES:
                con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
            cache[folder] = con
        return cache[folder]

    return of


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if isinstance(v, (bool, int)) else v


def rows(names, tuples):
    at = [names.index(c) for c in sorted(names)]
    return sorted(tuple(repr(plain(r[k])) for k in at) for r in tuples)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, small, name):
    folder = "/root/testdata/sf0.01" if name in LARGER else small
    got = QUERIES[name](spark, folder)
    want = duck(folder).execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, small, name):
    out = QUERIES[name](spark, small)
    assert len(set(out.columns)) == len(out.columns)
    out.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
