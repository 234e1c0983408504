import hashlib
import random

import numpy as np
import pytest

from tallyframe.llm import suffixes as S


def brute(rows):
    """(doc_id, n_bytes, spans, kept) of each row, by sets of strings."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                s = b[k : k + 50]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for k in range(len(b) - 49):
                if first[b[k : k + 50]] < i:
                    gone[k : k + 50] = True
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
        out.append((i, len(b), [tuple(e) for e in edges], bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = S.without_repeats(df, **more).collect()
    assert sorted(((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got), key=str) == brute(rows)
    return got


def planted(seed, n, passage=130):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(passage // 4) for _ in range(4)] + ["x" * 300, "ab" * 80, "Licensed under the same terms as all others here; see below."]
    rows = []
    for i in range(n):
        t = prose(rng.randrange(0, 60))
        if rng.random() < 0.7:
            p = rng.choice(shared)
            a = rng.randrange(0, max(1, len(p) - 55))
            t += " " + p[a : a + rng.randrange(40, 200)] + prose(rng.randrange(0, 30))
        rows.append((i * 3 % 101 + 1000 * (i // 101), t))
    return rows


def test_covers_all_differences():
    assert {(a - b) % S.MODULUS for a in S.COVER for b in S.COVER} == set(range(S.MODULUS))


def test_planted(spark):
    check(spark, planted(1, 120))


@pytest.mark.parametrize("hot", [1, 8])
def test_hot_anchors_small_chunks_small_buckets(spark, hot):
    check(spark, planted(2, 90), chunk=1500, bucket=700, hot=hot)


def test_odd_texts(spark):
    same = "the very same passage that is in several documents, long enough to count as one"
    rows = [(1, None), (2, ""), (3, same), (3, same), (3, "x " + same), (None, same), (None, same), (4, same[:50]), (5, same[:49]), (6, same + same), (7, "é" * 60), (8, "a" + "é" * 40), (9, "a" * 5000), (10, "a" * 50), (-5, "a" * 70), (11, "\U0001f600" * 13), (12, "\U0001f600" * 13)]
    got = check(spark, rows)
    check(spark, rows, chunk=1, hot=1)
    assert {r.doc_id: r.n_bytes for r in got}[11] == 52
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    extra = spark.createDataFrame([(1, same, 5, 6), (2, "and " + same, 5, 6)], "doc_id long, text string, chunk int, bits int")
    assert {r.doc_id: len(r.spans) for r in S.without_repeats(extra).collect()} == {1: 0, 2: 1}


def test_texts_are_not_shuffled(spark, monkeypatch):
    """However large the bits for chunks are, they come to the chunks, and the chunks' names leave nothing in the catalog."""
    monkeypatch.setattr(S, "NEAR", 0, raising=False)
    df = spark.createDataFrame(planted(3, 60), "doc_id long, text string").repartition(6)
    plan = S.without_repeats(df, chunk=1500, bucket=700)._jdf.queryExecution().executedPlan().treeString()
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert 1 <= len(moved) <= 2 and all("hashpartitioning(chunk" in line and "REPARTITION_BY_NUM" in line for line in moved)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("suffixes")]


def test_long_text_in_slabs(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    sizes = np.array([0, 30, 70, 0, 2900, 49, 50, 1901])
    whole = S.runs(data, sizes)
    parts = S.runs(data, sizes, slab=333)
    each = lambda r: [(a + k, p) for a, n, p in zip(*(x.tolist() for x in r[:3]), strict=True) for k in range(n)]
    assert each(whole) == each(parts)
    ends = np.cumsum(sizes)
    inside = [k for k in range(5000 - 49) if k + 50 <= ends[np.searchsorted(ends, k, "right")]]
    assert [a for a, _ in each(whole)] == inside


def test_suffixes_are_sorted_by_their_bytes_up_to_the_order_of_long_ties():
    rng = random.Random(5)
    strings = list({"".join(rng.choice("ab") for _ in range(rng.randrange(50, 76))).encode() for _ in range(80)} | {b"a" * 74, b"a" * 60})
    order, new, owner, first = S.sorted_suffixes(strings, np.zeros(len(strings), int))
    cut = [strings[o][k - first[o] : k - first[o] + 50] for k, o in enumerate(owner.tolist())]
    in_order = [cut[k] for k in order]
    assert [x[: S.MODULUS] for x in in_order] == sorted(x[: S.MODULUS] for x in cut)
    aligned = {}
    for k, s in enumerate(cut):
        aligned.setdefault((s, (k - first[owner[k]]) % S.MODULUS), k)  # the same string at the same way from an anchor
    assert new.sum() >= len(set(cut)) and all(a == b for a, b, n in zip(in_order, in_order[1:], new[1:], strict=False) if not n)


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in brute(rows)}
    got = S.op11_suffix_dedup(spark, data).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 0
