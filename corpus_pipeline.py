"""A training corpus from documents: quality, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of documents.

Cases: rows with null ids pass the near-duplicate and mixing stages as they are, as nothing can name them. Null and empty texts pass the quality
stage, are one group of near-duplicates, hold no secrets and no tokens, and so go in the mixing stage unless their id is null. Rows that repeat an id stay if
their texts are not near-duplicates. Equal rows are copies: one stays. Very long texts are handled whole. Extra columns, whatever
their names, go along up to the last stage. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import bpe, mixing, quality, secrets, simhash
from tallyframe.llm.common import cut, remove, shared_folder, table, text_batches


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps, by models of these documents and the labelled ones among them."""
    model, going_on = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.select_good(cut(quality.weighed(text_batches(docs), model, going_on))).select("row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: texts whose five-word shingles are similar by 0.8 or more."""
    return simhash.keep_first(docs, simhash.similar(docs))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows where the text changed."""
    found = secrets.scan_texts(docs, secrets.default_model(spark, sf_dir))
    some = F.size("spans") > 0
    new = {"text": F.when(some, F.col("hidden")).otherwise(F.col("row.text")), "n_chars": F.when(some, F.char_length("hidden").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as they are drawn. The budget is the smallest that holds every document once, so that
    mixing repeats the smaller sources, up to twice, and drops nothing but documents without a single word."""
    return mixing.mixed(docs, mixing.draws(docs, entropy=0.98, repeats=2.0, budget="cover"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document drawn, and the digest of what they decode to."""
    both = bpe.round_trip(docs)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", classify), ("SimHash near-dedup", deduplicate), ("secret scans", hide_secrets), ("mixing", mix), ("byte-level BPE", tokenize)]

#: None: the models of the first and third stage are fitted, which SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each but the last kept as Parquet in the shared folder, and removed once the next one is
    written. The last of them stays, as the result reads it; it goes with the application's checkpoints."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
