from collections import defaultdict

import numpy as np
import pytest

from tallyframe.llm import ann as A


def brute(rows, k, every=20):
    """(query_id, its neighbours) for each row that asks."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = []
    for n in {len(v) for _, v in ok}:
        same = [(i, v) for i, v in ok if len(v) == n]
        m = np.array([v for _, v in same])
        out += [(q, sorted((-(float(s)), i) for j, (s, (i, _)) in enumerate(zip((m * x).sum(axis=1), same, strict=True)) if j != own)[:k]) for own, (q, x) in enumerate(same) if q % every == 0]
    return sorted(x for x in out if x[1])


def got(df):
    out, ranks = [], defaultdict(list)
    for r in df.collect():
        ranks[r.query_id, r.rank].append((-r.score, r.vec_id))
    for q in sorted({q for q, _ in ranks}):
        lists = len(ranks[q, 1])
        n = max(r for i, r in ranks if i == q)
        assert all(len(ranks[q, r]) <= lists for r in range(1, n + 1))
        out += [(q, [ranks[q, r][0] for r in range(1, n + 1)])] if lists == 1 else [(q, sorted(x for r in range(1, n + 1) for x in ranks[q, r]))]
    return out


def recall(df, **more):
    found, want = dict(got(A.search(df, **more))), dict(brute([(r.vec_id, r.embedding) for r in df.collect()], 20))
    assert found.keys() == want.keys() and all(len(x) == 20 for x in found.values())
    exact = {(q, i): s for q in want for s, i in want[q]}
    assert all(abs(exact[q, i] - s) < 1e-12 for q in found for s, i in found[q] if (q, i) in exact)
    return sum(len({i for _, i in found[q]} & {i for _, i in want[q]}) for q in want) / (20 * len(want))


def test_recall(spark):
    assert recall(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")) >= 0.9


def test_recall_on_a_larger_table(spark, noise=0.8):
    """20,000 vectors in 300 clusters, a fifth of them copies of one vector."""
    rng = np.random.default_rng(12)
    v = rng.normal(size=(300, 24))[rng.integers(0, 300, 20_000)] + noise * rng.normal(size=(20_000, 24))
    v[rng.random(20_000) < 0.2] = v[7]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))], "vec_id long, embedding array<float>").where("vec_id <= 4000 or vec_id % 20 > 0")
    assert recall(df) >= 0.9
    assert recall(df, parts=8, leaf_rows=300) >= 0.9  # two levels of parts


def clustered(spark, n, dim=32):
    rng = np.random.default_rng(21)
    v = 3 * rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + 0.5 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))], "vec_id long, embedding array<float>")


def test_rows_are_moved_once_and_visits_follow_the_table(spark, monkeypatch):
    """On a table of five times the rows, rows are still moved once, and queries with their visits grow as the table does."""
    moved = {}
    dealt = A._dealt

    def counted(*args):
        left, right = dealt(*args)
        moved[n] = (left.count(), right.count())
        return left, right

    monkeypatch.setattr(A, "_dealt", counted)
    for n in (3_000, 15_000):
        A.search(clustered(spark, n), leaf_rows=max(100, int(n**0.5)))
    assert [moved[n][1] for n in moved] == [3_000, 15_000]
    assert moved[15_000][0] <= 1.6 * 5 * moved[3_000][0]


def test_queries_of_a_bin_are_cut_into_chunks(spark):
    kept = spark.range(100).selectExpr("id as uid", "id as vec_id", "binary('x') as vector", "int(id % 2) as leaf")
    asked = spark.range(50).selectExpr("id as uid", "id as query_id", "binary('x') as vector", "if(id < 40, array(0), array(0, 1)) as to")
    left, right = A._dealt(kept, asked, [50, 50], 2, 60, 20)
    bins = {r["part"]: r["bin"] for r in right.select("part", "bin").distinct().collect()}
    assert left.count() == 60 and len(bins) == 2
    assert {r["bin"]: r["n"] for r in right.groupBy("bin").agg({"chunk": "count"}).withColumnRenamed("count(chunk)", "n").collect()} == {bins[0]: 150, bins[1]: 50}


def test_clusters_need_few_parts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] * 3 + rng.normal(size=(4000, 32))
    router, probes = A.fit(x, 16)
    assert probes <= 6
    size = np.bincount(A.balanced_parts(A._nearest(x[:2000], x[:2000], 10, True), 16, rng), minlength=16)
    assert size.sum() == 2000 and size.max() <= np.ceil(1.05 * 2000 / 16)


@pytest.mark.parametrize("block", [4096, 7])
def test_small_and_odd(spark, block):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(40, None), (60, [0.0] * 4), (80, [nan, 1.0, 1.0, 1.0]), (100, [inf, 1.0, 1.0, 1.0]), (120, [None, 1.0, 1.0, 1.0]), (140, [1.0]), (None, [1.0] * 4)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(45)] + [(20, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, part int")
    found = got(A.search(df, k=20, block=block))
    want = brute(rows, 20)
    two = sorted(x for q, n in want if q == 20 for x in n)  # two rows have this id, and each is found by the other
    assert len(two) == 40 and dict(found)[20] == two
    assert [(q, [i for _, i in n]) for q, n in found if q != 20] == [(q, [i for _, i in n]) for q, n in want if q != 20]
    few = df.where("vec_id < 5")
    assert [(q, len(x)) for q, x in got(A.search(few))] == [(0, 4)]
    assert A.search(df.limit(0)).collect() == []


def test_copies_tie_by_id(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 0.3, 0.1 * 3] if i % 3 else rng.normal(size=3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [[i for _, i in n] for _, n in brute(rows, 20)]
    for more in ({"parts": 1, "block": 50}, {"parts": 4, "block": 90, "recall": 1.0}, {"parts": 4, "together": 5, "recall": 1.0}):
        assert [[i for _, i in n] for _, n in got(A.search(df, **more))] == want


def test_queries_of_their_own(spark):
    """Queries that are no rows find every row, and few probes still give k rows."""
    rng = np.random.default_rng(4)
    v = (np.eye(16)[rng.integers(0, 16, 600)] * 9 + rng.normal(size=(600, 16)) * 0.01).tolist()
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    ask = spark.createDataFrame([(k, v[k]) for k in range(10)], "vec_id long, embedding array<double>")
    found = got(A.search(df, ask, k=100, parts=16, recall=0.05))
    assert [q for q, _ in found] == list(range(10)) and all(len(n) == 100 for _, n in found)
    assert all(q in [i for _, i in n] for q, n in found)


def test_bins():
    first, several, n = A._bins([10, 200, 5, 5, 0, 90], 6, 100)
    spans = [set(range(a, a + m)) for a, m in zip(first, several, strict=True)]
    assert len(spans[1]) == 2 and not spans[1] & set().union(*(s for p, s in enumerate(spans) if p != 1)) and max(map(max, spans)) < n
    first, several, n = A._bins([3, 3, 3, 3], 2, 100)
    assert len({*first[2:], first[0]}) == 3 and n == 3 + (first[1] != first[0])


def test_neighbours_of_a_sample_are_found_in_bounded_memory():
    """Matrices of scores, and of their order, are not kept; they would take 0.3 GB here and 3.6 GB for the largest sample."""
    import tracemalloc

    x = np.random.default_rng(4).normal(size=(6000, 8))
    tracemalloc.start()
    near = A._nearest(x, x, 20, True)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 120e6
    for i in range(0, 6000, 500):
        score = x @ x[i]
        score[i] = -np.inf
        assert set(near[i].tolist()) == set(np.argsort(-score)[:20].tolist())
    assert A._nearest(x[:3], x[:2], 20, False).shape == (3, 2)
