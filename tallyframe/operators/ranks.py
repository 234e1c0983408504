"""Ranks over a whole table without one task that holds it.

Rows are sorted by ranges, so that a value which a third of all rows have is spread over several; ranks are counted within each range, and a summary of
each range (its first and last value, its rows and its distinct values) tells where it starts and whether its first value began in an earlier one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut


def ranked(rows: DataFrame, by: list[str], tie: list[str], tiles: int | None = None) -> DataFrame:
    """rows with position (from 1, in order of by and then tie), rank, dense_rank and percent_rank by `by` alone, and tile (of so many) by position.

    Nulls come first and tie. by and tie together should tell rows apart; where they don't, position and tile are any of the possible ones.
    Equal rows keep their number. An empty table gives an empty result. Names that start with two underscores are taken.
    """
    placed = cut(rows.orderBy(*by, *tie)).select("*", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__place"))
    inside = Window.partitionBy("__range").orderBy(*by)
    counted = placed.withColumn("__rank", F.rank().over(inside)).withColumn("__dense", F.dense_rank().over(inside))
    value = F.struct(*by)
    ranges = counted.groupBy("__range").agg(F.count("*").alias("n"), F.max("__dense").alias("values"), F.max("__rank").alias("last_rank"), F.min_by(value, "__place").alias("first"), F.max_by(value, "__place").alias("last"))
    starts, total, distinct, rank, last = [], 0, 0, 0, None
    for r in ranges.orderBy("__range").collect():  # a row for each range
        same = last is not None and r["first"] == last
        starts.append((r["__range"], total, distinct - same, rank if same else None))
        if r["values"] > 1 or not same:
            rank = total + r["last_rank"]
        total, distinct, last = total + r["n"], distinct + r["values"] - same, r["last"]
    begin = rows.sparkSession.createDataFrame(starts, "__range int, __start long, __values long, __before long")
    out = counted.join(F.broadcast(begin), "__range")
    position = F.col("__start") + F.col("__place")
    rank_of = F.when((F.col("__dense") == 1) & F.col("__before").isNotNull(), F.col("__before")).otherwise(F.col("__start") + F.col("__rank"))
    columns = [(position + 1).alias("position"), rank_of.alias("rank"), (F.col("__values") + F.col("__dense")).alias("dense_rank"), ((rank_of - 1) / F.lit(max(1, total - 1))).alias("percent_rank")]
    if tiles:
        columns.append(_tile(position, total, tiles).alias("tile"))
    return out.select(*rows.columns, *columns)


def _tile(position: Column, total: int, tiles: int) -> Column:
    """Tiles of equal size; the first ones have one row more if the rows can't be shared out evenly."""
    size, more = divmod(total, tiles)
    edge = more * (size + 1)
    large = F.floor(position / F.lit(size + 1))
    return (F.when(position < edge, large).otherwise(more + F.floor((position - edge) / F.lit(max(1, size)))) + 1).cast("long")
