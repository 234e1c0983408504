import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as C
from tallyframe.llm import bpe, quality, secrets, simhash

from tests.llm import test_quality, test_secrets, test_simhash


def plain(spark, sf_dir, docs):
    """What each stage should leave, a list of rows each, by loops over rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {i for i, _ in test_quality.brute(docs.select("doc_id", "text"), *quality.fit(docs, labels))}
    kept = [r.asDict() for r in docs.collect() if r["doc_id"] in kept]
    yield kept
    group = test_simhash.brute_similar([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if group[r["text"]] == r["doc_id"]]
    yield kept
    bits = secrets.default_model(spark, sf_dir)
    for r in kept:
        found = test_secrets.base(r["text"])
        r["text"] = test_secrets.plain_hidden(r["text"], sorted(found + test_secrets.extra(r["text"], found, bits)))
        r["n_chars"] = len(r["text"])
    yield kept


def test_stages_against_plain(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    for want, (name, stage) in zip(plain(spark, sf_dir, docs), C.STAGES[:3], strict=True):
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns, name
        got = sorted((r.asDict() for r in now.collect()), key=lambda r: r["doc_id"])
        assert got == sorted(want, key=lambda r: r["doc_id"]), name
    before = {r.doc_id: r for r in now.collect()}
    mixed = C.mix(spark, now, sf_dir)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert times.keys() == before.keys() and max(times.values()) <= 2
    assert {r.doc_id: r.text for r in mixed.collect()} == {i: r.text for i, r in before.items()}
    share = defaultdict(int)
    for i, n in times.items():
        share[before[i].source] += n * len(before[i].text.split())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    rows = C.tokenize(spark, mixed, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == times
    for r in rows:
        text = before[r.doc_id].text
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_run_and_planted_rows(spark, tmp_path):
    """Near copies go, clean documents stay, secrets are hidden; null and empty texts don't break it."""
    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    text = docs.where("doc_id = 1").first().text
    more = spark.createDataFrame([(9001, text, "en", "src1", len(text)), (9002, text.replace(" is ", " was ", 1), "en", "src2", len(text)), (9003, None, "en", "src3", 0), (9004, "", "en", None, 0), (None, "no id here", "en", "src1", 10)], docs.schema)
    docs.union(more).withColumns({"_copy": F.lit(1), "row": F.lit("x"), "spans": F.lit(2.0), "h0": F.lit(3)}).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    ids = Counter(r.doc_id for r in C.run(spark, str(tmp_path)).collect())
    assert 1 in ids and not ids.keys() & {9001, 9002}
    assert ids[None] == 1
    good = {r.doc_id for r in spark.read.parquet(f"{src}/labels.parquet").where("quality = 1").collect()}
    first = good & {r.first for r in simhash.similar(docs).where("stays").collect()}
    assert len(first & ids.keys()) >= 0.97 * len(first)


def test_empty(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{src}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
