import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import simhash as S


def plain(text):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() if x]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    """doc_id -> component by all pairs."""
    fps = {}
    for i, t in rows:
        fps.setdefault(plain(t), []).append(i)
    keys = list(fps)
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= 3:
                up[root(keys[a])] = root(keys[b])
    low = {}
    for k, ids in fps.items():
        ids = [i for i in ids if i is not None]
        if ids:
            low[root(k)] = min([low.get(root(k), min(ids)), *ids])
    return sorted(((i, f"{k:016x}", low.get(root(k))) for k, ids in fps.items() for i in ids), key=str)


def got(df):
    rows = S.near_duplicates(df).collect()
    return sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "two Words", "a b c", "É À ß A b\x0bc\x0cd " * 50, "x" * 10_000])
def test_fingerprint(text):
    assert S.simhash(text) == plain(text)


def test_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(d) == brute([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q r s t"), (None, None)]
    d = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fp string")
    assert got(d) == brute(rows)
    assert got(d.limit(0)) == []


def test_kept(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "a b c d"), (3, "other words stand here"), (None, "a b c d"), (3, "one more text of this id"), (0, "third text"), (3, "third text")]
    d = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, row string").withColumns({"h0": F.lit(1), "first": F.lit(2), "stays": F.lit(3)})
    kept = S.keep_first(d, S.similar(d))
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(0, "third text"), (1, "a b c d"), (3, "one more text of this id"), (3, "other words stand here"), (None, "a b c d")], key=str)
    assert S.keep_first(d.limit(0), S.similar(d.limit(0))).collect() == []


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_similar(rows, bits=S.CANDIDATE_BITS):
    """text -> smallest id of its component, by all pairs of different texts."""
    made = S.Shingles()
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    texts = list(ids)
    sets, words = [shingle_set(t) for t in texts], [made.words(t) for t in texts]
    fp = np.array([S._majority(made.of(w, 2)) if len(w) else 0 for w in words], np.uint64)
    up = list(range(len(texts)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(texts)):
        for b in np.flatnonzero(np.bitwise_count(fp[:a] ^ fp[a]) <= bits):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                up[root(a)] = root(b)
    low = {}
    for k, t in enumerate(texts):
        low.setdefault(root(k), []).extend(i for i in ids[t] if i is not None)
    return {t: min(low[root(k)], default=None) for k, t in enumerate(texts)}


def edited(seed, n):
    """Texts with copies that differ in a few words, in chains and stars, and some in other places."""
    rng = np.random.default_rng(seed)
    draw = lambda k: [f"w{x}" for x in rng.integers(0, 3000, k)]
    base = [draw(int(rng.integers(3, 200))) for _ in range(6)]
    out = [" ".join(b) for b in base]
    for _ in range(n):
        b = base[int(rng.integers(0, len(base)))]
        b = list(b)
        for _ in range(int(rng.integers(0, 4))):
            b[int(rng.integers(0, len(b)))] = f"new{rng.integers(0, 99)}"
        if rng.random() < 0.2:
            base.append(b)
        out.append(" ".join(b) if rng.random() < 0.8 else " ".join(b).upper())
    return out


@pytest.mark.parametrize("more", [{}, {"segments": 2, "sets": 7}])
def test_similar_against_brute_force(spark, more):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + k, t) for k, t in enumerate(edited(3, 150))] + [(2000, None), (2001, ""), (2002, " \n"), (None, "only null ids here"), (2003, "a b"), (2004, "A  b")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, fp string, node int")
    want = brute_similar(rows)
    text = dict(zip([(r.h0, r.h1) for r in df.select(*S._digests(F.col("text"))).collect()], [t or "" for _, t in rows], strict=True))
    got = {text[r.h0, r.h1]: r.component_id for r in S.similar(df, **more).collect()}
    assert got == want and len(set(want.values())) < len(want) - 50


def test_wide_rings_against_all_pairs(spark):
    """Buckets of one and of two segments, for several budgets, connect what all pairs connect."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 25)
    fps = sorted({int(b) ^ int(sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 12)), replace=False))) for b in np.repeat(base, 12)})
    u = np.array(fps, np.uint64)
    df = spark.createDataFrame([(k, f) for k, f in enumerate(fps)], "node long, fp long")
    for bits in (0, 3, 9):
        i, j = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u) <= bits, 1))
        want = S.forest(len(u), i, j)
        for segments in (1, 2) if bits else (1,):
            found = {r.node: r.component for r in S.components(S.links(df, bits, block=40, segments=segments)).collect()}
            assert [found.get(k, k) for k in range(len(u))] == want.tolist(), (bits, segments)


def test_dense_buckets_and_blocks(spark):
    """Chains of near fingerprints in buckets far over a block, against all pairs."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40)
    fps = {int(b) ^ int(sum(1 << int(k) for k in rng.choice(64, 2, replace=False))) for b in np.repeat(base[:6], 60)} | set(map(int, base))
    fps = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    df = spark.createDataFrame([(f, f) for f in fps], "node long, fp long")
    found = {r.node: r.component for r in S.components(S.links(df, 3, block=16)).collect()}
    low = list(range(len(fps)))
    u = [f & (2**64 - 1) for f in fps]
    for _ in range(len(fps)):
        before = list(low)
        for a in range(len(fps)):
            for b in range(a):
                if (u[a] ^ u[b]).bit_count() <= 3:
                    low[a] = low[b] = min(low[a], low[b])
        if before == low:
            break
    assert {f: found.get(f, f) for f in fps} == {f: fps[low[k]] for k, f in enumerate(fps)}
    assert S.links(df, 3, block=16).count() <= 4 * 40 * len(fps)


@pytest.mark.parametrize("small", [200_000, 0])
def test_components_with_hubs(spark, small, monkeypatch):
    """Stars, a long path and a star whose hub is its largest node, with labels broadcast and joined, and with hot keys."""
    from tallyframe.operators import graph

    monkeypatch.setattr(graph, "HOT_ROWS", 20)
    edges = [(0, k) for k in range(1, 60)] + [(1000, k) for k in range(900, 960)] + [(k, k + 1) for k in range(2000, 2070)] + [(59, 900), (3000, 3000)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), small=small).collect()}
    want = {k: 0 for k in [*range(60), 1000, *range(900, 960)]} | {k: 2000 for k in range(2000, 2071)} | {3000: 3000}
    assert found == want


def test_links_that_are_made_once(spark):
    """Links that come out as another spanning forest each time they are made give the same components."""
    from tallyframe.llm.common import components

    def star(batches):
        import random

        import pandas as pd

        for rows in batches:
            for _, part in rows.groupby(rows["id"] % 5):
                root = random.choice(part["id"].tolist())
                yield pd.DataFrame({"src": part["id"], "dst": root}).query("src != dst")

    links = spark.range(0, 200, numPartitions=1).mapInPandas(star, "src long, dst long")
    for _ in range(4):
        assert {(r.node, r.component) for r in components(links).collect()} == {(k, k % 5) for k in range(200)}


@pytest.mark.parametrize("most", [200_000, 0])
def test_by_component(spark, monkeypatch, most):
    from tallyframe.llm import common
    from tallyframe.operators import graph

    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    monkeypatch.setattr(graph, "HOT_ROWS", 30)
    rows = spark.createDataFrame([(k, k % 7 if k % 2 else 0) for k in range(200)], "node long, component long")
    least = rows.groupBy("component").agg(F.min("node").alias("least"))
    got = {r.node: r.least for r in common.by_component(rows, least).collect()}
    want = {k: min(x for x in range(200) if (x % 7 if x % 2 else 0) == (k % 7 if k % 2 else 0)) for k in range(200)}
    assert got == want


def test_overlapping_forests_are_thinned(spark):
    """Many nodes with the same few partners: about one link each is left, and the same components."""
    edges = spark.createDataFrame([(k, r) for k in range(20, 320) for r in range(0, 20, 2)] + [(1000, 1001), (1001, 1001)], "src long, dst long")
    left = S.thinned(edges)
    assert left.count() <= 300 + 9 + 1
    assert sorted(map(tuple, S.components(left).collect())) == sorted(map(tuple, S.components(edges).collect()))
