"""Sharding by weighted rendezvous hashing.

Every key is scored against every shard, score = -ln(u) / weight with u drawn from a hash of key and shard, and goes to
the shard with the lowest score. A new shard only takes the keys that it scores lowest for; no key moves between the
others. Numbers inside a shard come from counts of buckets of a shard and from row numbers inside a bucket, so that no
task holds a whole shard; a bucket made large by one key is dealt out further by what its rows hold. Equal rows are one with a
count until they are numbered, so numbers don't depend on how files or tasks cut the rows.

Cases: a null key is the key "\\N". Rows that repeat a key share its shard and get numbers of their own. A null text
has no bytes: size 1, checksum 0. A very long text is measured where it is read. An empty table gives an empty result. Only the key and the
text are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded, cut, one_by_one, table

#: Rows that are numbered together; a bucket of over four times as many is dealt out.
BUCKET_ROWS = 5_000


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, that a key goes to; ties go to the smaller number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    name = F.coalesce(key.cast("string"), F.lit("\\N"))

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(name, F.lit(str(shard))), 11).cast("double") + 0.5) / F.lit(float(2**53))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))

    return F.array_min(F.array(*(score(s, w) for s, w in enumerate(weights))))["shard"]


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row: its key as doc_id, size, text_crc32, shard, slot (gapless in the shard) and grown_shard."""
    rows = docs.count()
    buckets = max(1, -(-rows // (len(weights) * bucket_rows)))
    read = docs.select(
        F.col(key_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32"),
        shard_of(F.col(key_col), weights).alias("shard"),
        shard_of(F.col(key_col), grown if grown is not None else weights).alias("grown_shard"),
        F.pmod(F.xxhash64(F.col(key_col).cast("string"), F.lit("bucket")), F.lit(buckets)).alias("bucket"),
    )
    base = cut(read.groupBy(*read.columns).agg(F.count("*").alias("rows")))
    sized = base.groupBy("shard", "bucket").agg(F.sum("rows").alias("count"))
    large = cut(sized.where(F.col("count") > 4 * bucket_rows).select("shard", "bucket", F.ceil(F.col("count") / bucket_rows).alias("parts")))
    dealt = base.join(bounded(large), ["shard", "bucket"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), "parts"), F.lit(0))).drop("parts")
    key = ["shard", "bucket", "part"]
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*key).agg(F.sum("rows").alias("count"))
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy(*key).orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(bounded(cut(starts)), key).withColumn("slot", F.col("start") + F.sum("rows").over(inside) - F.col("rows"))
    return one_by_one(placed).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("k")).alias("slot"), "grown_shard")


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op3_rendezvous_sharding": op3_rendezvous_sharding}
#: None: the checksum of a text has no counterpart in DuckDB. tests/llm/test_sharding.py has a plain version.
SQL: dict[str, str] = {}
