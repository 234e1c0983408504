import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import quality as Q
from tallyframe.llm.common import cut


def test_grams():
    g = Q.Grams()
    assert len(g.buckets(None)) == len(g.buckets("")) == len(g.buckets(" \n")) == 0
    assert len(g.buckets("one two three")) == 5
    assert g.buckets("a a a a")[1] == Q._SAME
    assert (Q.Grams().buckets("Some words!! HERE") == g.buckets("some words!! HERE")).all()
    assert g.buckets("here")[0] != g.buckets("HERE")[0]


def test_counts_cover_every_document(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text", (F.col("doc_id") % 3 == 0).alias("good"))
    want = np.zeros((2, Q.BUCKETS), np.int64)
    for r in docs.collect():
        n = np.bincount(Q.Grams().buckets(r.text), minlength=Q.BUCKETS)
        want[0] += n
        want[1] += n * r.good
    got = np.zeros((2, Q.BUCKETS), np.int64)
    for r in Q.counts(docs.repartition(3)).collect():
        got[r.kind, r.bucket] = r.n
    assert (got == want).all()


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0
    model, going_on = Q.fit(docs, labels.where(~held))
    kept = Q.select_good(cut(Q.weighed(docs.select("doc_id", "text"), model, going_on))).select("row.doc_id", F.lit(True).alias("kept"))
    rows = labels.where(held).join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce(F.col("kept"), F.lit(False)).cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in rows.collect()}
    assert share[1] >= 0.99 and share[0] <= 0.03


def brute(docs, model, going_on, k=None):
    """Rows, by Gumbel top-k over all of them in a list."""
    rows = []
    for r in docs.withColumn("noise", Q._noise(F.col("doc_id"), F.col("text"), 7)).collect():
        b = Q.Grams().buckets(r.text)
        weight = float((model.astype(np.float32).astype(float) + going_on)[b].sum())
        rows.append((weight + r.noise, weight, len(b), r.doc_id))
    some = sorted((r for r in rows if r[2]), reverse=True)
    k = sum(r[1] >= 0 for r in some) if k is None else k
    least = some[k - 1][0] if 0 < k <= len(some) else np.inf if not k else -np.inf
    return sorted((i, n) for key, _, n, i in rows if not n or key >= least)


@pytest.mark.parametrize("k", [None, 0, 1, 97, 400, 10_000])
def test_brute_force(spark, k):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model, going_on = Q.fit(docs, labels)
    keyed = cut(Q.weighed(docs, model, going_on))
    got = sorted((r.doc_id, r.n_grams) for r in Q.select_good(keyed, k).select("row.doc_id", "n_grams").collect())
    assert got == brute(docs.select("doc_id", "text"), model, going_on, k)
    if k in (1, 97, 400):
        assert len(got) == k + keyed.where("n_grams = 0").count()


def test_noise_decides_between_near_weights(spark):
    """Of two texts whose weights differ by d, the likelier one comes first in 1 / (1 + exp(-d)) of draws."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    model = np.zeros(Q.BUCKETS)
    first = [r.gumbel_key for r in Q.weighed(docs, model, 1.0).orderBy("row.doc_id").collect()]
    second = [r.gumbel_key for r in Q.weighed(docs, model, 0.0, seed=8).orderBy("row.doc_id").collect()]
    share = np.mean(np.array(first) > np.array(second))
    assert abs(share - 1 / (1 + np.exp(-1))) < 0.03


@pytest.mark.parametrize("values", [[], [1.0], [2.0] * 7, [3.0, 1.0, 2.0, 2.0, 2.0, -5.0], list(np.random.default_rng(1).gumbel(size=500)), [1e300, -1e300, 0.0, 5e-324, 1.0, 1.0 + 2**-52]])
def test_kth_largest(spark, values):
    df = cut(spark.createDataFrame([(float(v),) for v in values], "key double"))
    order = sorted(values, reverse=True)
    for k in {0, 1, 2, 3, 5, len(values) - 1, len(values), len(values) + 1} - {-1}:
        want = -np.inf if k >= len(values) else np.inf if k == 0 else order[k - 1]
        assert Q.kth_largest(df, k, ways=3) == want


def test_odd_rows(spark, data):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 1.0), (1, "a word", 2.0), (1, "a word", 2.0), (2, "x " * 200_000, 3.0)], "doc_id long, text string, gumbel_key double")
    docs = docs.withColumns({"row": F.lit(1), "log_weight": F.lit("x"), "n_grams": F.lit(0)})
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model, going_on = Q.fit(docs, labels)
    assert going_on == np.inf
    kept = Q.select_good(cut(Q.weighed(docs, model, going_on))).select("row.*")
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))
    two = Q.select_good(cut(Q.weighed(docs, np.zeros(Q.BUCKETS), 0.001)), 1)
    assert two.count() == 3  # the long text, and those without words
    model, going_on = Q.fit(docs.limit(0), labels)
    assert Q.select_good(cut(Q.weighed(docs.limit(0), model, going_on))).collect() == []
    assert Q.fit(docs, labels.limit(0))[1] == np.inf


def test_level():
    assert Q.level(np.array([]), np.array([1.0])) == -np.inf
    assert 2 < Q.level(np.array([3.0, 4, 5]), np.array([0.0, 1, 2])) < 3
    assert Q.level(np.array([1.0, 1]), np.array([1.0])) <= 1
