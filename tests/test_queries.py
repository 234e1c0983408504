"""Every registered query with SQL against DuckDB, and the same after its input has been reordered."""

import glob
import os

import duckdb
import pytest

from tallyframe.plans import queries as Q
from tallyframe.plans import views as W


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, tuples):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(round(t[i], 9) if isinstance(t[i], float) else t[i] for i in at) for t in tuples), key=str)


@pytest.mark.parametrize("name", Q.SQL)
def test_against_sql(spark, con, data, name):
    df = Q.QUERIES[name](spark, data)
    want = con.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_quick_digests(spark, data):
    import hashlib

    for r in Q.QUERIES["quick_digests"](spark, data).collect():
        assert r.quick == hashlib.blake2b(f"{r.path}{r.size}{r.ord}".encode(), digest_size=16).hexdigest()
        assert (r.algorithm, r.digest, r.sha256) == ("blake2b", hashlib.blake2b(r.path.encode(), digest_size=32).hexdigest(), hashlib.sha256(r.path.encode()).hexdigest())


def test_entry_lists_them(spark):
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).columns) == 7


@pytest.mark.parametrize("name", ["duplicate_groups", "detect_moves", "apply_moves", "delta_upserts", "version_history", "similarity_clusters"])
def test_row_order_does_not_matter(spark, data, name, monkeypatch):
    before = sorted(map(str, Q.QUERIES[name](spark, data).collect()))
    read = W.table
    monkeypatch.setattr(W, "table", lambda s, d, t: read(s, d, t).repartition(5).sortWithinPartitions(*[c for c in read(s, d, t).columns[:1]], ascending=False))
    assert sorted(map(str, Q.QUERIES[name](spark, data).collect())) == before
