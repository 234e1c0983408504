"""Keyed merges over tables without updates: the result is a new snapshot."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.delta import last_by_key


def merge(target: DataFrame, source: DataFrame, keys: list[str], order: str = "ord", untouched: tuple[str, ...] = ()) -> DataFrame:
    """target with the last source row of each key in place of its own; columns in untouched keep their old value where
    there is one. The columns are the target's."""
    last = last_by_key(source, *keys, order=order)
    columns = target.columns
    fresh = last.select(*(F.col(c) if c in last.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in columns))
    if untouched:
        old = target.select(*keys, *(F.col(c).alias(f"_{c}") for c in untouched))
        fresh = fresh.join(old, keys, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in untouched else F.col(c) for c in columns))
    return target.join(last.select(*keys), keys, "left_anti").select(columns).unionByName(fresh)


class Snapshots:
    """A table as a folder of snapshots; the newest is the one that a marker written after it names. A reader never sees a half-written one,
    and a merge never reads what it overwrites."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _marks(self) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("at timestamp, name string").json(f"{self.folder}/_marks")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read(self) -> DataFrame | None:
        marks = self._marks()
        newest = marks.orderBy(F.desc("at"), F.desc("name")).first() if marks is not None else None
        return self.spark.read.parquet(f"{self.folder}/{newest['name']}") if newest else None

    def write(self, df: DataFrame) -> None:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/{name}")
        self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(name).alias("name")).coalesce(1).write.mode("append").json(f"{self.folder}/_marks")

    def merge(self, source: DataFrame, keys: list[str], order: str = "ord", untouched: tuple[str, ...] = ()) -> None:
        now = self.read()
        self.write(last_by_key(source, *keys, order=order) if now is None else merge(now, source, keys, order, untouched))
