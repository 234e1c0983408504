"""What several operators of this package need: lineage cuts, bounded batches, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import graph
from tallyframe.operators.graph import cut, forest, shared_folder, small_batches  # noqa: F401  used by the operators beside this module

#: A side is broadcast only when a count has shown that it has no more rows than this.
BROADCAST_ROWS = 200_000
#: Rows of text handed to a Python worker at once; the session's setting is lowered, never raised.
TEXT_BATCH = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever it is stored."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def nested(df: DataFrame) -> Column:
    """A whole row as one column, so that names which an operator adds beside it can't clash with the input's."""
    return F.struct("*").alias("row") if df.columns else F.lit(None).alias("row")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it is known to have no more than so many rows. df should be cut or cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def one_by_one(counted: DataFrame, most: int = 4096) -> DataFrame:
    """Each row as often as its count (rows) says, with k from 0: in steps, so that no array is longer than `most`."""
    steps = counted.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {most}L"))))
    return steps.withColumn("k", F.explode(F.sequence(F.col("step") * most, F.least(F.col("rows"), (F.col("step") + 1) * most) - 1)))


def text_batches(df: DataFrame, rows: int = TEXT_BATCH) -> DataFrame:
    """df, after making sure that Arrow batches of whole texts stay small."""
    return small_batches(df, rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the links (src, dst); component is the smallest node reachable."""
    return graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b"))


def by_component(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows joined with least, which has a row for each component, on component. A component may hold a third of all rows, so least is broadcast if it is
    small enough, and otherwise what large components need is."""
    least = cut(least)
    if least.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(least), "component")
    rows = cut(rows)
    return graph.look_up(rows, "component", least, graph.hot_keys(rows, "component", rows.count()))
