import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import negatives as N


def plain(rows, asks):
    out = []
    v = [(i, x, np.floor(256 * np.array(e, float)).astype(int)) for i, e, x in rows]
    for i, x, e in v:
        if asks(i):
            score = sorted((-int(e @ f), j, y) for j, y, f in v if j != i)
            for s, p, _ in [t for t in score if t[2] == x][:5]:
                hard = [(n, t) for t, n, y in score if y != x and -80 * s <= -100 * t <= -100 * s][:5]
                out += [(i, p, k + 1, n, -s, -t) for k, (n, t) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_sql(spark, sf):
    data = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = con.sql(N.SQL["op13_hard_negatives"])
    got = N.op13_hard_negatives(spark, data)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and rows


@pytest.mark.parametrize("block,together", [(8192, 4096), (20, 3)])
def test_against_plain(spark, block, together):
    rng = random.Random(3)
    base = [[rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)] for _ in range(12)]
    rows = [(i * 3, rng.choice(base), rng.choice("aaaab")) for i in range(150)]  # many ties and copies; most have one label
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)
    got = sorted(map(tuple, N.mine(df, F.col("vec_id") % 5 == 0, block=block, together=together).collect()))
    assert got == plain(rows, lambda i: i % 5 == 0) and len(got) > 100


def test_limits():
    score = np.array([9, 7, 7, 5, 4, 4, 1, -3])
    for positive in range(-6, 14):
        want = [k for k, s in enumerate(score) if 80 * positive <= 100 * s <= 100 * positive]
        for k in (1, 2, 9):
            a, b = N.limited(score, positive, 80, 100, k)
            assert list(range(a, b)) == want[:k]


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (2, [0.9, 0.0], 2), (3, None, 1), (4, [nan, 1.0], 2), (5, [None, 1.0], 2), (6, [], 2), (7, [1.0, 0.0], None), (None, [1.0, 0.0], 2), (8, [1.0], 2), (9, [0.0, 0.0], 2), (10, [1e300, 0.0], 2), (100, [0.0, 0.0], 1), (200, [-1.0, 0.0], 3)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label int, uid int, v string")
    got = sorted(map(tuple, N.mine(df, F.col("vec_id") % 100 == 0).collect()))
    assert [r for r in got if r[0] == 0][:2] == [(0, 1, 1, 2, 65536, 65536), (0, 1, 2, 2, 65536, 256 * 230)]
    assert {r[0] for r in got} == {0, 100} and all(r[4] == r[5] == 0 for r in got if r[0] == 100)
    assert N.mine(df.limit(0), F.lit(True)).collect() == [] and N.mine(df, F.lit(False)).collect() == []
