"""Distinct counts and quantiles that are kept per day and merged, instead of counted again.

A state is a row for each day and group: how many rows, an HLL sketch of distinct values and a KLL sketch of a measure. Arrivals add states of their
own under the number of their batch, so that a batch that is repeated replaces itself; reading unites them. States are merged by any coarser key without looking at the rows again.

Cases: null values count as rows only, and as missing in both sketches. A group without any value has null estimates. An empty table has no states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Relative standard error of distinct counts is about 1.04 / sqrt(2 ** LG_K); of a quantile's rank about 2 / K.
LG_K, K = 12, 200


def states(rows: DataFrame, day: Column, groups: list[str], distinct: str, measure: str) -> DataFrame:
    """(day, groups, n, distinct_sketch, measure_sketch)."""
    return rows.groupBy(day.alias("day"), *groups).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(K)).alias("measure_sketch"))


def merged(kept: DataFrame, by: list[str]) -> DataFrame:
    """States of a coarser key."""
    return kept.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("measure_sketch").alias("measure_sketch"))


def estimates(kept: DataFrame, shares: tuple[float, ...] = (0.5,)) -> DataFrame:
    """states with distinct (an estimate) and quantiles (an array, one for each share) in place of the sketches."""
    some = F.kll_sketch_get_n_double("measure_sketch") > 0
    quantiles = F.when(some, F.array(*(F.kll_sketch_get_quantile_double("measure_sketch", F.lit(float(s))) for s in shares)))
    columns = [c for c in kept.columns if not c.endswith("_sketch")]
    return kept.select(*columns, F.hll_sketch_estimate("distinct_sketch").alias("distinct"), quantiles.alias("quantiles"))


def add(kept: DataFrame, folder: str, batch: int) -> None:
    """Keeps states under the number of the batch that they came from."""
    kept.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def read(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """All kept states, merged by columns of theirs."""
    return merged(spark.read.parquet(folder), by)


def follow(stream: DataFrame, day: Column, groups: list[str], distinct: str, measure: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Adds the states of each micro-batch of a stream."""
    return stream.writeStream.foreachBatch(lambda rows, batch: add(states(rows, day, groups, distinct, measure), folder, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
