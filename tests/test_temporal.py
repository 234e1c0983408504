import bisect
import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import temporal as T

DAY = datetime.datetime(2024, 1, 1)


def moment(k):
    return None if k is None else DAY + datetime.timedelta(seconds=k)


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot", [10**6, 40])
def test_as_of(spark, hot):
    rng = random.Random(1)
    key = lambda: "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(400)])) for i in range(600)]
    right = [(i, key(), rng.choice([None, *range(0, 400, 3)])) for i in range(300)]
    df = lambda rows: spark.createDataFrame([(i, k, moment(t)) for i, k, t in rows], "id long, k string, t timestamp").repartition(3)
    last = {}
    for i, k, t in right:
        if k is not None and t is not None:
            last[k, t] = max(i, last.get((k, t), -1))
    times = {k: sorted(t for q, t in last if q == k) for k, _ in last}
    want = {}
    for i, k, t in left:
        at = bisect.bisect_right(times.get(k, []), t) if k is not None and t is not None else 0
        want[i] = last[k, times[k][at - 1]] if at else None
    found = T.as_of(df(left), df(right), ["k"], "t", "t", order=("id",), hot_rows=hot)
    got = found.collect()
    assert {r.id: r.as_of.id if r.as_of else None for r in got} == want and len(got) == len(left)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert T.as_of(df(left).limit(0), df(right), ["k"], "t", "t").collect() == []
    assert {r.as_of for r in T.as_of(df(left), df(right).limit(0), ["k"], "t", "t").collect()} == {None}


def test_as_of_hot_key_is_dealt_out(spark):
    left = spark.range(4000).select(F.lit("one").alias("k"), F.timestamp_seconds("id").alias("t"))
    right = spark.createDataFrame([("one", moment(-10**9 + 5), 7)], "k string, t timestamp, v int").withColumn("t", F.timestamp_seconds(F.lit(5)))
    found = T.as_of(left, right, ["k"], "t", "t", hot_rows=100)
    assert found.where("as_of.v = 7").count() == 3995
    both = left.select("k", F.col("t").alias("_t"))
    cuts = T._pieces(both, ["k"], "_t", 100)
    sizes = [r["count"] for r in both.join(cuts, "k").groupBy(T._piece("_t")).count().collect()]
    assert max(sizes) < 100 and sum(sizes) == 4000


def test_overlapping(spark):
    rng = random.Random(2)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.choice([None, *range(-500, 3000)])
            long = rng.choice([0, 1, 2, 7, 60, 60, 1000, 5000, -3, None])
            out.append((i, "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), a, None if a is None or long is None else a + long))
        return out

    left, right = spans(150), spans(140)
    df = lambda rows: spark.createDataFrame([(i, k, moment(a), moment(b)) for i, k, a, b in rows], "id long, k string, start timestamp, end timestamp")
    found = T.overlapping(df(left), df(right), ["k"])
    got = sorted((r.left.id, r.right.id) for r in found.collect())
    ok = lambda r: None not in r and r[2] < r[3]
    want = sorted((x[0], y[0]) for x in left for y in right if ok(x) and ok(y) and x[1] == y[1] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 500
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert T.overlapping(df(left), df(right).limit(0), ["k"]).collect() == []


@pytest.mark.parametrize("hot", [10**6, 10])
def test_trailing(spark, hot):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-100, 300)]), rng.randrange(9)) for i in range(250)]
    df = spark.createDataFrame([(i, k, moment(t), v) for i, k, t, v in rows], "id long, k string, t timestamp, v long")
    got = T.trailing(df, ["k"], "t", 30, {"n": F.count("*"), "total": F.sum("v")}, hot_rows=hot).collect()
    want = {}
    for i, k, t, _ in rows:
        near = [v for _, k2, t2, v in rows if t is not None and t2 is not None and k2 == k and t - 30 <= t2 <= t]
        want[i] = (len(near), sum(near)) if t is not None else (None, None)
    assert {r.id: (r.n, r.total) for r in got} == want and len(got) == 250
