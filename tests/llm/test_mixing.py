import math
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import mixing as M


def rows_of(df):
    return sorted((r.doc_id, r.source, r.tokens, round(r.weight, 6), r.epoch, r.position, round(r.progress, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark, data, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("mix") / "d.parquet")
    d = spark.read.parquet(f"{data}/documents.parquet")
    d.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "big").when(F.col("doc_id") % 7 == 0, "small").when(F.col("doc_id") % 50 == 3, None).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 4))).write.parquet(at)
    return spark.read.parquet(at), at


@pytest.mark.parametrize("entropy, repeats", [(0.98, 4.0), (0.9, 1.3), (1.0, 3.0), (0.1, 50.0)])
def test_against_sql(skewed, entropy, repeats):
    docs, at = skewed
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/*.parquet'")
    want = con.execute(M.sql(entropy, repeats, block_docs=9)).fetchall()
    assert rows_of(M.draws(docs, entropy, repeats, block_docs=9)) == sorted(want)


def test_properties(skewed):
    docs, _ = skewed
    got = M.draws(docs, 0.97, None, block_docs=10).collect()
    spent, budget = defaultdict(int), {}
    by = defaultdict(list)
    for r in got:
        spent[r.source] += r.tokens
        by[r.source, r.epoch].append(r.position)
        budget[r.source] = r.weight
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    total = docs.select(F.sum(F.size(F.expr("filter(split(text, '[ \\t\\n\\r]+'), x -> x <> '')")))).first()[0]
    w = {r.source: r.weight for r in got}
    assert abs(sum(w.values()) - 1) < 1e-9
    assert -sum(x * math.log(x) for x in w.values()) >= 0.97 * math.log(len(w)) - 1e-6
    assert all(spent[s] <= total * w[s] + 1 for s in w)


def test_cover_keeps_every_document(skewed):
    docs, _ = skewed
    n = Counter(r.doc_id for r in M.draws(docs, 1.0, 2.0, "cover", block_docs=20).collect())
    assert len(n) == docs.count() and max(n.values()) == 2
    out = M.mixed(docs, M.draws(docs, 1.0, 2.0, "cover"))
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == n


def test_odd_rows(spark):
    rows = [(1, "a", "one two"), (2, "a", None), (3, None, "x y z"), (4, "empty", ""), (None, "a", "lost id here")] + [(9, "hot", "same words")] * 60
    d = spark.createDataFrame([(i, s, t, 7) for i, s, t in rows], "doc_id long, source string, text string, n int")
    got = M.draws(d, 1.0, None, block_docs=4).collect()
    assert "empty" not in {r.source for r in got} and {r.source for r in got} == {"a", "\\N", "hot"}
    by = defaultdict(list)
    for r in got:
        by[r.source, r.epoch].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    full = M.draws(d, None, None, block_docs=4).collect()
    assert Counter(r.doc_id for r in full) == Counter(i for i, s, _ in rows if s != "empty")
    assert M.draws(d.limit(0)).collect() == []
    assert M.draws(d.where("doc_id = 4")).collect() == []
    assert Counter(r.doc_id for r in M.mixed(d, M.draws(d, None, None)).collect())[9] == 60


def test_layout_does_not_matter(spark):
    """One id with many texts and many equal rows, in two layouts and orders: the same rows, positions and what falls off."""
    rows = [(9, "hot", f"same words {k % 40}" + " more" * (k % 5)) for k in range(300)] + [(9, "hot", "equal row")] * 90 + [(k, "b", "x y z " * (k % 7)) for k in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"rows": F.lit(1), "k": F.lit("k"), "times": F.lit(2), "row": F.lit(3)})
    one = rows_of(M.draws(d.repartition(7), 1.0, None, block_docs=8))
    assert one == rows_of(M.draws(d.orderBy(F.desc("text")).coalesce(2), 1.0, None, block_docs=8)) and len(one) > 300
    by = defaultdict(list)
    for r in one:
        by[r[1], r[4]].append(r[5])
    assert all(len(set(p)) == len(p) for p in by.values())
    assert [sorted(M.one_by_one(spark.createDataFrame([(n,)], "rows long"), 3).select("k").collect()) for n in (1, 3, 4, 10)] == [[(k,) for k in range(n)] for n in (1, 3, 4, 10)]
    assert M.mixed(d, M.draws(d, None, None)).columns == d.columns
