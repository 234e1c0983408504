import math
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import sharding as S


def plain(key, weights):
    name = "\\N" if key is None else str(key)

    def score(s):
        h = xxhash.xxh64_intdigest(str(s).encode(), xxhash.xxh64_intdigest(name.encode(), 42))
        return -math.log(((h >> 11) + 0.5) / 2**53) / weights[s], s

    return min(score(s) for s in range(len(weights)))[1]


def check(rows, found, weights, grown):
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in found), key=str) == sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain(i, weights), plain(i, grown)) for i, t in rows), key=str
    )
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(r.grown_shard in (r.shard, len(weights)) for r in found)


def test_documents(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    check(rows, S.op3_rendezvous_sharding(spark, data).collect(), [1.0] * 16, [1.0] * 17)
    check(rows, S.assign(d, [1.0] * 16, [1.0] * 17, bucket_rows=3).collect(), [1.0] * 16, [1.0] * 17)


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "é" * 70_000), (3, None)] + [(7, "hot")] * 90
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    check(rows, S.assign(d, [1.0, 2.0], [1.0, 2.0, 1.0], bucket_rows=5).collect(), [1.0, 2.0], [1.0, 2.0, 1.0])
    assert S.assign(d.limit(0), [1.0]).collect() == []


def test_weights_and_moves(spark):
    got = spark.range(20_000).select(S.shard_of(F.col("id"), [1.0, 2.0, 1.0]).alias("s"), S.shard_of(F.col("id"), [1.0, 2.0, 1.0, 1.0]).alias("g")).collect()
    n = Counter(r.s for r in got)
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    moved = sum(r.s != r.g for r in got)
    assert abs(moved / 20_000 - 0.2) < 0.02
