"""Messages found through stored inverted lists: a search reads the lists of its words, and of the messages only those that it returns.

A posting is a word and the message that has it; lists are kept by a hash of the word and sorted by it, so that a search opens the folders of its words and skips the row groups of others. How many
messages have each word is kept beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.chat import WEIGHTS

#: Folders that lists are dealt to.
BUCKETS = 64


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def write(messages: DataFrame, folder: str) -> None:
    """Lists of the words of messages (message_id, body_text), lower case. A message counts once for a word; null texts have none."""
    words = F.array_distinct(F.filter(F.split(F.lower("body_text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    posted = messages.where("body_text is not null").select("message_id", F.explode(words).alias("word")).withColumn("bucket", _bucket(F.col("word")))
    # a word that most messages have is one folder's list, but not one task's work
    dealt = posted.repartition("bucket", F.pmod(F.xxhash64("message_id"), F.lit(8))).sortWithinPartitions("bucket", "word", "message_id")
    dealt.write.partitionBy("bucket").parquet(f"{folder}/lists")
    frequencies = posted.groupBy("bucket", "word").agg(F.count("*").alias("messages"))
    frequencies.repartition("bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{folder}/frequencies")


def _of(df: DataFrame, words: list[str]) -> DataFrame:
    """The rows of these words, from their folders only."""
    known = sorted({w.lower() for w in words})
    buckets = [r[0] for r in df.sparkSession.createDataFrame([(w,) for w in known], "word string").select(_bucket(F.col("word"))).distinct().collect()] if known else []
    return df.where(F.col("bucket").isin(buckets) & F.col("word").isin(known))


def frequencies(spark: SparkSession, folder: str, words: list[str]) -> DataFrame:
    """(word, messages): how many messages have each of the words."""
    return _of(spark.read.parquet(f"{folder}/frequencies"), words).select("word", "messages")


def search(spark: SparkSession, folder: str, words: list[str], k: int = 20) -> DataFrame:
    """(message_id, score) of the k best messages: the weighted share of the words that they have, as by chat.search with words alone."""
    wanted = len({w.lower() for w in words})
    found = _of(spark.read.parquet(f"{folder}/lists"), words).groupBy("message_id").agg(F.count("*").alias("n"))
    share = F.col("n") / F.lit(float(max(1, wanted)))
    return found.select("message_id", F.bround(WEIGHTS[1] * share, 6).alias("score")).orderBy(F.desc("score"), "message_id").limit(k)
