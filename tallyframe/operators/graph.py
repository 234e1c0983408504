"""Connected components, joins on keys that may be hot, and the cut of lineage that iterative plans need."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it has over so many rows, and over a hundred-thousandth of all: there are never more hot keys than that.
HOT_ROWS, HOT_KEYS = 200, 100_000
#: Labels of no more nodes than this are broadcast.
SMALL = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir that Spark keeps for this application. If that is unset, a temporary folder on a
    local master; on a cluster executors would not share it, so it is an error there."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tallyframe-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the folder of spark.checkpoint.dir, which all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, after making sure that Arrow batches of whole texts stay small: the session's setting is lowered, never raised."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return df


def hot_keys(df: DataFrame, key: str, rows: int) -> DataFrame | None:
    """The keys with so many rows that one task should not get them all; None if there are none."""
    hot = df.groupBy(key).count().where(F.col("count") > max(HOT_ROWS, rows // HOT_KEYS)).select(key)
    return None if hot.isEmpty() else cut(hot)


def look_up(df: DataFrame, key: str, found: DataFrame, hot: DataFrame | None) -> DataFrame:
    """df joined with found, which has one row for each key. What hot keys need from found is broadcast: HOT_KEYS rows at most."""
    if hot is None:
        return df.join(found, key)
    hot = F.broadcast(hot)
    few = F.broadcast(found.join(hot, key, "left_semi"))
    return df.join(hot, key, "left_anti").join(found, key).unionByName(df.join(few, key))


def components(edges: DataFrame, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(node, component) for the ends of edges (a, b); component is the smallest node that can be reached.

    Nodes take the smallest label around them and then their label's label, so a path of n nodes settles in about log n
    rounds. Only counts and emptiness tests reach the driver. Edges are kept first, so that both directions are of the same
    ones. Labels of up to `small` nodes are broadcast, so that no row is moved to look one up. Beyond, labels are joined, and what
    the hub of a star, or a label that many nodes have, needs is broadcast on its own, so no task gets all their rows.
    """
    edges = cut(edges.select("a", "b"))
    arcs = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(arcs.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    few = labels.count() <= small
    rows = 0 if few else arcs.count()
    hubs = None if few else hot_keys(arcs, "a", rows)
    near = F.broadcast if few else lambda df: df
    for _ in range(rounds):
        offered = look_up(arcs, "a", near(labels.withColumnRenamed("node", "a")), hubs).groupBy("b").agg(F.min("component").alias("offer"))
        nearer = labels.join(near(offered), F.col("node") == F.col("b")).select("node", F.col("component").alias("was"), F.least("component", "offer").alias("label"))
        nearer = nearer if few else cut(nearer)
        above = labels.select(F.col("node").alias("label"), F.col("component").alias("over"))
        step = cut(look_up(nearer, "label", near(above), None if few else hot_keys(nearer, "label", rows)).select("node", "was", F.least("label", "over").alias("component")))
        labels = step.select("node", "component")
        if step.where("was <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component under the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def numbered(df: DataFrame, *order, name: str = "number") -> DataFrame:
    """df with its rows' places in an order, from 0. Rows are sorted by ranges and numbered within each; only the ranges' counts are summed in one task."""
    rows = cut(df.orderBy(*order)).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_place"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row for each range
    return rows.join(F.broadcast(starts), "_range").select(*df.columns, (F.col("_start") + F.col("_place")).alias(name))
