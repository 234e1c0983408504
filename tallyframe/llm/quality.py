"""Quality by importance resampling.

Texts become hashed word n-grams. Two generative models are fitted: one of target texts (labelled as good, a bounded sample) and
one of the raw corpus (every document). Each draws n-grams from a bag and, after each, goes on or stops; the models' chances to
go on differ by a factor that is fitted on held-out labelled texts. A text's log importance weight is the sum over its n-grams
of log target - log raw, with that factor. Adding Gumbel noise and taking the k largest is sampling k texts without replacement
in proportion to the weights. Unless k is given, it is the number of texts that are likelier under the target
model (weight 0 or more), so it follows the corpus. The k-th largest key is found exactly by counting keys in ever
finer intervals; only counts reach the driver.

Cases: a null or empty text has no n-grams and weight 0; it is nothing to sample, takes no place among the k and stays. Keys
tie only for rows of equal id and text, as noise comes from a hash of both; ties at the k-th key all stay. Without usable labels
of both kinds, nothing is known against any text and all stay. Rows with null ids are scored like others. Very long texts are
counted in arrays of their own length. An empty table gives an empty result. The input's columns are nested in one, so that
their names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, nested, table, text_batches

#: Buckets of hashed n-grams; each model is one vector of this length.
BUCKETS = 1 << 16
#: The bound on labelled rows that the target model and the factor are fitted on.
LABELLED = 20_000
_WORD = re.compile(r"\w+|[^\w\s]+")
#: Tokens of a kind share a name: a word like the one before it, a word all in capitals.
_SAME, _KNOWN = 1, 500_000


class Grams:
    """Buckets of a text's words and word pairs. A word that repeats the one before counts as the repeat mark."""

    def __init__(self):
        self.ids: dict[str, int] = {}

    def _id(self, word: str) -> int:
        h = 0xCBF29CE484222325
        for b in (word.lower() if len(word) < 2 or not word.isupper() else "\x01" + word.lower()).encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return (h ^ h >> 29) & 0x7FFFFFFF

    def buckets(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text) if text else []
        if not words:
            return np.zeros(0, np.int64)
        ids = self.ids
        if len(ids) > _KNOWN:
            ids.clear()
        for w in set(words).difference(ids):
            ids[w] = self._id(w)
        one = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        same = np.r_[False, one[1:] == one[:-1]]
        one[same] = _SAME
        two = (one[:-1] * 1_000_003 + one[1:] * 31 + 7) & 0x7FFFFFFFFFFF
        return np.concatenate([one, two ^ two >> 17]) % BUCKETS


def counts(texts: DataFrame) -> DataFrame:
    """(kind, bucket, n): how often each bucket occurs in the rows (text, good), kind 0 in all rows and 1 in good ones.
    A task returns at most one row for a kind and bucket, so the shuffle is bounded by tasks, not by words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, total = Grams(), np.zeros((2, BUCKETS), np.int64)
        for rows in batches:
            for text, good in zip(rows["text"], rows["good"], strict=True):
                b = grams.buckets(text)
                if len(b):
                    one = np.bincount(b, minlength=BUCKETS) if len(b) > 4096 else None
                    for kind in (0, 1) if good else (0,):
                        if one is None:
                            np.add.at(total[kind], b, 1)
                        else:
                            total[kind] += one
        kind, bucket = np.nonzero(total)
        yield pd.DataFrame({"kind": kind.astype(np.int32), "bucket": bucket.astype(np.int32), "n": total[kind, bucket]})

    return texts.select("text", "good").mapInPandas(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))


def _noise(id_col: Column, text: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, text), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(u))


def weighed(docs: DataFrame, model: np.ndarray, going_on: float = 0.0, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """row (all columns of docs), log_weight, n_grams and gumbel_key, the noisy weight. going_on: the log factor for each n-gram."""
    held = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    @F.pandas_udf("weight double, grams long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ratio, grams = held.value.astype(np.float64) + going_on, Grams()
        for texts in parts:
            found = [grams.buckets(t) for t in texts]
            yield pd.DataFrame({"weight": [float(ratio[b].sum()) for b in found], "grams": [len(b) for b in found]})

    both = docs.select(nested(docs), of(F.col(text_col)).alias("found"), _noise(F.col(id_col), F.col(text_col), seed).alias("noise"))
    return both.select("row", F.col("found.weight").alias("log_weight"), F.col("found.grams").alias("n_grams"), (F.col("found.weight") + F.col("noise")).alias("gumbel_key"))


def kth_largest(keys: DataFrame, k: int, ways: int = 4096) -> float:
    """The k-th largest value of the only column of keys: intervals are cut into `ways` parts until one double is left.
    -inf if there are no more than k."""
    name = keys.columns[0]
    key = F.col(name)
    low, high, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if n <= k:
        return -np.inf
    if k <= 0:
        return np.inf
    while low < high:
        width = (high - low) / ways
        if low + width <= low or high - width >= high:  # neighbouring doubles
            few = keys.where((key >= low) & (key <= high)).groupBy(name).count().orderBy(F.desc(name)).collect()
            for value, count in few:
                if k <= count:
                    return value
                k -= count
        part = F.least(F.floor((key - F.lit(low)) / F.lit(width)), F.lit(ways - 1)).cast("int")
        counts = keys.where((key >= low) & (key <= high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("part")).collect()  # at most `ways` rows
        for r in counts:
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return low


def level(good: np.ndarray, bad: np.ndarray) -> float:
    """The value between sorted samples that loses the smallest sum of shares; -inf if one is empty. A good text lost
    counts four times."""
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.r_[cuts[0], (cuts[1:] + cuts[:-1]) / 2]
    lost = 4 * np.searchsorted(np.sort(good), cuts) / len(good) + 1 - np.searchsorted(np.sort(bad), cuts) / len(bad)
    return float(cuts[np.argmin(lost)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = LABELLED, seed: int = 7) -> tuple[np.ndarray, float]:
    """The log ratio of the models by bucket, and the log factor of going on; inf without labels of both kinds. labels:
    (doc_id, quality). Half of the sample goes to the target model, the other half sets the factor; the raw model counts every document."""
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(order, "doc_id").limit(most)
    sample = F.broadcast(sample.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"), (F.pmod(order, F.lit(2)) == 0).alias("_model")))
    rows = text_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(sample, "_id", "left")
    total = np.zeros((2, BUCKETS))
    for r in counts(rows.select("text", F.coalesce((F.col("_quality") == 1) & F.col("_model"), F.lit(False)).alias("good"))).collect():  # at most 2 * BUCKETS rows
        total[r["kind"], r["bucket"]] = r["n"]
    smooth = total + 0.5
    model = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    if not total[1].any():
        return np.zeros(BUCKETS), np.inf
    scored = weighed(rows.where("not _model"), model, id_col="_id", seed=seed).groupBy("row._id").agg(F.first("row._quality").alias("quality"), F.min(F.col("log_weight") / F.greatest("n_grams", F.lit(1))).alias("mean")).collect()  # at most `most` rows
    mean = {q: np.array([r["mean"] for r in scored if r["quality"] == q]) for q in (0, 1)}
    return model, -level(mean[1], mean[0])


def select_good(keyed: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of weighed() that Gumbel top-k sampling keeps. keyed is read several times: it should be cut."""
    some = keyed.where(F.col("n_grams") > 0)
    if k is None:
        k = some.where(F.col("log_weight") >= 0).count()
    return keyed.where((F.col("gumbel_key") >= kth_largest(some.select("gumbel_key"), k)) | (F.col("n_grams") == 0))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, going_on = fit(docs, table(spark, sf_dir, "labels"))
    keyed = weighed(text_batches(docs), model, going_on).select("row.doc_id", "log_weight", "n_grams", "gumbel_key")
    return select_good(cut(keyed)).select("doc_id", F.round("log_weight", 6).alias("log_weight"), "n_grams", F.round("gumbel_key", 6).alias("key"))


QUERIES = {"op7_importance_resampling": op7_importance_resampling}
#: None: fitted models have no counterpart in SQL. tests/llm/test_quality.py has the sampling by brute force and held-out accuracy.
SQL: dict[str, str] = {}
