import numpy as np
import pytest

from tallyframe.llm import pivots as V


def brute(rows, threshold=0.98):
    """rows: (id, label, vector). -> sorted (id, n_links, component)."""
    ok = [k for k, (_, label, v) in enumerate(rows) if label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    near = [[] for _ in rows]
    for a in ok:
        for b in ok:
            if a != b and rows[a][1] == rows[b][1] and len(rows[a][2]) == len(rows[b][2]):
                x, y = np.array(rows[a][2], float), np.array(rows[b][2], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold or (x == y).all():
                    near[a].append(b)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((rows[k][0], len(near[k]), min((rows[s][0] for s in seen if rows[s][0] is not None), default=None)))
    return sorted(out, key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, label, v, 3) for i, label, v in rows], "vec_id long, label int, embedding array<double>, n long")
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in V.near_duplicates(df, **more).collect()), key=str)


def cloud(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, dim))
    v = base[rng.integers(0, len(base), n)] + spread * rng.normal(size=(n, dim))
    return [(int(i), int(rng.integers(0, 3)), x.tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("spread", [0.05, 0.15, 0.2])
@pytest.mark.parametrize("pivots, block", [(16, 1024), (5, 7)])
def test_brute_force(spark, spread, pivots, block):
    rows = cloud(int(spread * 100), 260, 24, spread)
    assert got(spark, rows, pivots=pivots, block=block) == brute(rows)


def test_low_dimension(spark):
    rows = cloud(3, 200, 3, 0.3)
    assert got(spark, rows, pivots=20, block=9) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [2.0, 0.0]), (2, 1, [1.0, 0.0]), (2, 1, [1.0, 0.0]), (3, None, [1.0, 0.0]), (4, 1, None), (5, 1, [0.0, 0.0]), (6, 1, [nan, 1.0]), (7, 1, [inf, 1.0]),
            (8, 1, [None, 1.0]), (9, 2, [1.0, 0.0]), (10, 1, [1.0]), (11, 1, []), (None, 1, [1.0, 0.01]), (12, 1, [1e300, 1e290]), (13, 1, [1e-310, 0.0])]
    with np.errstate(all="ignore"):
        want = [r for r in brute([r for r in rows if r[0] not in (12, 13, 11)], 0.98)]
    found = got(spark, rows)
    assert [r for r in found if r[0] in (3, 4, 5, 6, 7, 8, 9, 10, 11)] == sorted([(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)], key=str)
    assert [r for r in got(spark, [r for r in rows if r[0] not in (12, 13, 11)])] == want
    assert got(spark, []) == []


def test_more_pivots_than_some_lengths_have_vectors(spark):
    rows = cloud(4, 150, 24, 0.1) + [(1000 + i, 1, [1.0, 0.1 * (i % 3)]) for i in range(9)]
    assert got(spark, rows, pivots=300) == brute(rows)


def test_hot_copies(spark):
    rows = [(i, 1, [1.0, 2.0, 3.0]) for i in range(60)] + [(60 + i, 1, [1.0, 2.0, 3.0 + i / 1000]) for i in range(40)] + cloud(9, 50, 3, 0.01)
    rows = [(k, label, v) for k, (_, label, v) in enumerate(rows)]
    assert got(spark, rows, pivots=4, block=6) == brute(rows)


def test_sql(spark, tmp_path):
    import duckdb

    rows = cloud(7, 200, 16, 0.12) + [(900, None, [1.0] * 16), (901, 1, None), (902, 1, [0.0] * 16)]
    spark.createDataFrame([(i, label, v) for i, label, v in rows], "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in V.op8_pivot_near_dedup(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(V.ALL_PAIRS).fetchall()) and any(r[1] for r in got)


def test_permutations_and_counts():
    """The permutation is in order of nearness; no link misses the full count; pairs that are far apart seldom have it."""
    rng = np.random.default_rng(1)
    base = V.units(rng.normal(size=(400, 12)))
    x, y = base, V.units(base + 0.04 * rng.normal(size=base.shape))
    pivots = V.units(rng.normal(size=(40, 12)))
    reach = np.sqrt(2 - 2 * 0.98) + 1e-7
    order, first, some = V.permutations(np.concatenate([x, y]), pivots, reach)
    near = np.concatenate([x, y]) @ pivots.T
    assert (order == np.argsort(-near, axis=1)[:, : V.SHARED]).all()
    assert first[np.arange(800), order[:, 0]].all() and (some >= first).all() and some[np.arange(800)[:, None], order].all()
    pair = V._counted(order, some, np.arange(400), np.arange(400, 800))
    linked = x @ y.T >= 0.98
    assert linked.any() and pair[linked].all() and pair[~linked].mean() < 0.2
