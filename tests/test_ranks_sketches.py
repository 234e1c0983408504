import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import tables
from tallyframe.operators import ranks, reporting, sketches


@pytest.mark.parametrize("values", ["many ties", "one value", "distinct", "nulls"])
def test_ranked_against_sorting(spark, values):
    rng = random.Random(4)
    draw = {"many ties": lambda i: rng.choice([1, 1, 1, 2, 5, 9]), "one value": lambda i: 7, "distinct": lambda i: i * 37 % 401, "nulls": lambda i: rng.choice([None, 3, 4])}[values]
    rows = [(i, draw(i)) for i in range(401)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(6)
    got = {r.id: r for r in ranks.ranked(df, ["v"], ["id"], tiles=7).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[0]))
    key = [r[1] for r in order]
    distinct = list(dict.fromkeys(key))
    for n, (i, v) in enumerate(order):
        r, rank = got[i], key.index(v) + 1
        assert (r.position, r.rank, r.dense_rank) == (n + 1, rank, distinct.index(v) + 1)
        assert r.percent_rank == (rank - 1) / 400 and r.tile == (n // 58 + 1 if n < 2 * 58 else 2 + (n - 116) // 57 + 1)


def test_ranked_without_rows_and_more_tiles_than_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, 5)], "id long, v long")
    assert ranks.ranked(df.limit(0), ["v"], ["id"], 4).collect() == []
    assert [(r.rank, r.tile) for r in ranks.ranked(df, ["v"], ["id"], 4).orderBy("id").collect()] == [(1, 1), (1, 2)]


def test_a_value_of_many_rows_is_spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20_000).withColumn("v", F.lit(1)).repartition(4)
    try:
        placed = ranks.cut(df.orderBy("v", "id")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed) > 1 and max(r["count"] for r in placed) < 15_000


def events(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(i), datetime.date(2024, 1, 1 + int(rng.integers(5))), "ab"[int(rng.integers(2))], int(rng.integers(3000)), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "id long, day date, kind string, who long, v double")


def test_sketches_merge_within_their_errors(spark, tmp_path):
    e, at = events(spark, 20_000), str(tmp_path / "states")
    for k in range(3):
        sketches.add(sketches.states(e.where(f"id % 3 = {k}"), F.col("day"), ["kind"], "who", "v"), at, k)
    sketches.add(sketches.states(e.where("id % 3 = 1"), F.col("day"), ["kind"], "who", "v"), at, 1)  # repeated
    shares = (0.1, 0.5, 0.9)
    local = e.toPandas()
    for by in (["kind"], ["kind", "day"], []):
        for r in sketches.estimates(sketches.read(spark, at, by), shares).collect():
            own = local
            for c in by:
                own = own[own[c] == r[c]]
            assert r.n == len(own)
            assert abs(r.distinct - own.who.nunique()) <= 4 * 1.04 / np.sqrt(2**sketches.LG_K) * own.who.nunique()
            for share, q in zip(shares, r.quantiles, strict=True):
                assert abs((own.v <= q).mean() - share) < 0.02


def test_sketches_of_nulls_and_none(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1), "a", None, None)], "day date, kind string, who long, v double")
    r = sketches.estimates(sketches.states(df, F.col("day"), ["kind"], "who", "v")).first()
    assert (r.n, r.distinct, r.quantiles) == (1, 0, None)
    assert sketches.states(df.limit(0), F.col("day"), ["kind"], "who", "v").collect() == []


def test_sketches_follow_a_stream(spark, tmp_path):
    e, at = events(spark, 500), str(tmp_path)
    e.repartition(4).write.json(f"{at}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).json(f"{at}/in")
    for _ in range(2):  # a second start finds nothing new
        sketches.follow(stream, F.col("day"), ["kind"], "who", "v", f"{at}/states", f"{at}/cp").awaitTermination()
    assert {r.kind: r.n for r in sketches.read(spark, f"{at}/states", ["kind"]).collect()} == {r.kind: r["count"] for r in e.groupBy("kind").count().collect()}


def test_totals_take_one_pass(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "x", 4)], "p string, q string, n long")
    found = reporting.totals(df, [["p", "q"], ["p"], []], F.sum("n").alias("n"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", "x", 1, 0), ("a", None, 2, 0), ("b", "x", 4, 0), ("a", None, 3, 1), ("b", None, 4, 1), (None, None, 7, 3)], key=str)
    assert plan.count("Expand") == 1 and plan.count("Scan") == 1


def test_split_at_gaps(spark):
    t = lambda s: None if s is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [("a", s) for s in (50, 0, 9, 19, 20, 20)] + [("b", 5), ("c", None), (None, 1)]
    df = spark.createDataFrame([(k, t(s)) for k, s in rows], "k string, at timestamp").repartition(3)
    got = {(r.key, r.start, r.end, r.n) for r in tables.split_at_gaps(df, "k", "at", 10).collect()}
    assert got == {("a", t(0), t(9), 2), ("a", t(19), t(20), 3), ("a", t(50), t(50), 1), ("b", t(5), t(5), 1), (None, t(1), t(1), 1)}
    tables.register(spark)
    df.selectExpr("k as key", "at as ts", "10 as gap").createOrReplaceTempView("gaps")
    assert spark.sql("select * from split_at_gaps(table(gaps) partition by key order by ts)").count() == 5
