import hashlib

import duckdb
import numpy as np
import pytest

from tallyframe.llm import codes as C


def plain(rows, parts=8, entries=16, rounds=6):
    """{id: (code, error)} and the codebooks, by Lloyd's rounds from scratch. rows: (id, vector)."""
    rows = sorted(rows)
    x = np.floor(4096 * np.array([v for _, v in rows], float)).astype(int).reshape(len(rows), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()
    assign = lambda: ((x[:, :, None] - book[None]) ** 2).sum(axis=3)
    for _ in range(rounds):
        code = assign().argmin(axis=2)
        for p in range(parts):
            for e in range(book.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    book[p, e] = [int(s) // len(own) for s in own.sum(axis=0)]
    away = assign()
    return {i: (bytes(c.tolist()).hex(), int(d)) for (i, _), c, d in zip(rows, away.argmin(axis=2), away.min(axis=2).sum(axis=1), strict=True)}, book


def hexed(found):
    return {r.vec_id: (bytes(r.code).hex(), r.error) for r in found.collect()}


def test_query_against_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{data}/embeddings.parquet'")
    want = con.sql(C.SQL["op12_delta_lloyd"])
    got = C.op12_delta_lloyd(spark, data)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("n", [1, 5, 16, 300])
def test_against_plain_rounds(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(i) * 7 - 40, np.round(rng.normal(size=32), 2).tolist()) for i in rng.permutation(n)]
    rows += [(10_000 + i, rows[0][1]) for i in range(n // 2)]  # copies
    df = spark.createDataFrame([(i, v, None, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, code int").repartition(5)
    found, book = C.codebooks(df)
    want, final = plain(rows)
    assert hexed(found) == want and np.array_equal(book, final)
    assert np.abs(C.decoded(bytes.fromhex(want[rows[0][0]][0]), book) * 4096 - 4096 * np.array(rows[0][1])).max() ** 2 <= want[rows[0][0]][1] + 1e4


def test_rounds_end_when_nothing_changes(spark):
    rows = [(i, [float(i % 4)] * 8) for i in range(40)]
    found, book = C.codebooks(spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label"), rounds=50)
    assert hexed(found) == plain(rows)[0]


def test_rows_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    good = [(i, [i / 10, -i / 7.0] * 4, 1 if i % 2 else None) for i in range(30)]
    odd = [(100, None, 1), (101, [], 1), (102, [nan] + [0.0] * 7, 1), (103, [inf] * 8, 2), (104, [None] + [1.0] * 7, 1), (105, [1.0] * 7, 1), (106, [1.0] * 16, 1)]
    kinds = "vec_id long, embedding array<double>, label int"
    spark.createDataFrame(good + odd + [(50, [0.0] * 8, 3), (51, [1e30] * 8, 3), (None, [0.5] * 8, 3)], kinds).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in C.op12_delta_lloyd(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(30), 50, 51, None}
    assert got[0].label_error == sum(got[i].error for i in range(0, 30, 2)) and got[1].label_error == sum(got[i].error for i in range(1, 30, 2))
    assert got[50].label_error == got[51].label_error == got[50].error + got[51].error + got[None].error
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert C.op12_delta_lloyd(spark, f"{tmp_path}/none").collect() == []
    assert hashlib.sha256(b"").hexdigest()  # codebooks of no rows


def test_only_changes_are_shuffled():
    rng = np.random.default_rng(2)
    parts = rng.integers(-50, 50, (200, 4, 3))
    old = rng.integers(0, 5, (200, 4))
    new = old.copy()
    new[7, 2] = (old[7, 2] + 1) % 5
    count, total = C.differences(parts, old, new, 5)
    assert count[2, new[7, 2]] == 1 and count[2, old[7, 2]] == -1 and np.abs(count).sum() == 2
    assert np.array_equal(total[2, new[7, 2]], parts[7, 2]) and np.array_equal(total[2, old[7, 2]], -parts[7, 2])
