"""Messages: normal form, natural keys, and search by words and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.vectors import cosine

NATURAL_KEY = ("source_platform", "source_workspace", "source_channel", "source_message_id")
# The weights of a match by meaning, by words and by age.
WEIGHTS = (0.40, 0.40, 0.20)


def normal_text(text: Column) -> Column:
    """White space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized(messages: DataFrame) -> DataFrame:
    return messages.withColumn("body_text", normal_text(F.col("body_text"))).withColumn("body_hash", F.sha2(normal_text(F.col("body_text")), 256))


def distinct_messages(messages: DataFrame) -> DataFrame:
    """The last ingested of each natural key. Null parts of the key equal each other."""
    last = Window.partitionBy(*NATURAL_KEY).orderBy(F.desc("ingested_at"), "message_id")
    return messages.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def ranking(semantic: Column, lexical: Column, recency: Column) -> Column:
    return WEIGHTS[0] * semantic + WEIGHTS[1] * lexical + WEIGHTS[2] * recency


def lexical_score(text: Column, words: list[str]) -> Column:
    """The share of the words that a text holds."""
    if not words:
        return F.lit(0.0)
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.size(F.array_intersect(tokens, F.array(*(F.lit(w.lower()) for w in sorted(set(words)))))) / float(len({w.lower() for w in words}))


def search(messages: DataFrame, words: list[str], vector: list[float] | None = None, k: int = 20, newest: str | None = None, half_life_days: float = 30.0) -> DataFrame:
    """The k best messages by words, vector (column embedding) and age, as far as each is given."""
    lex = lexical_score(F.col("body_text"), words)
    sem = cosine(F.col("embedding"), F.lit(vector)) if vector is not None else F.lit(0.0)
    age = F.exp(-F.datediff(F.to_timestamp(F.lit(newest)), "created_at") * (0.6931471805599453 / half_life_days)) if newest else F.lit(0.0)
    scored = messages.withColumn("score", F.bround(ranking(sem, lex, age), 6))
    return scored.where((lex > 0) | (sem > 0)).orderBy(F.desc("score"), "message_id").limit(k)
