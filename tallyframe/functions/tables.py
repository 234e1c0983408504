"""Table functions: a row-by-row walk over an ordered partition that gives rows of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="key string, start timestamp, end timestamp, n long", useArrow=False)
class SplitAtGaps:
    """Runs of a key's rows (key, ts, gap in seconds), which have to come in order, without a gap of so many seconds or more between neighbours. Holds one run at a time.
    Rows without a time are left out."""

    def __init__(self):
        self.run = None

    def eval(self, row):
        if row["ts"] is None:
            return
        if self.run and (row["ts"] - self.run[2]).total_seconds() >= row["gap"]:
            yield tuple(self.run)
            self.run = None
        if self.run:
            self.run[2], self.run[3] = row["ts"], self.run[3] + 1
        else:
            self.run = [row["key"], row["ts"], row["ts"], 1]

    def terminate(self):
        if self.run:
            yield tuple(self.run)


def split_at_gaps(rows: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """(key as text, start, end, n): the runs of each key."""
    ready = rows.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.lit(seconds).alias("gap"))
    return SplitAtGaps(ready.asTable().partitionBy("key").orderBy("ts"))


def register(spark: SparkSession) -> None:
    """split_at_gaps for SQL: select * from split_at_gaps(table(rows) partition by key order by ts)."""
    spark.udtf.register("split_at_gaps", SplitAtGaps)
