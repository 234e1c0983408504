"""Delta events, arrivals and topics as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyframe.operators import delta
from tallyframe.operators.lookup import new_mounts
from tallyframe.operators.merge import Snapshots
from tallyframe.plans.schemas import DELTA_EVENT, FILE_INSTANCE


def events(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Delta events from a folder of JSON lines, so many files at a time."""
    return spark.readStream.schema(DELTA_EVENT).option("maxFilesPerTrigger", files_a_batch).json(path)


def apply(stream: DataFrame, table: Snapshots, checkpoint: str) -> StreamingQuery:
    """Keeps a table of instances up to date. Within a batch, events meet the table as it was before the batch: the last upsert of a
    source counts, and a deletion then marks the row. The checkpoint is the cursor: none yet is a full sync, else it goes on."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        now = table.read()
        known = now if now is not None else spark.createDataFrame([], FILE_INSTANCE)
        fresh = delta.upserts(rows, known)
        if not fresh.isEmpty():
            table.merge(fresh.select([c for c in FILE_INSTANCE_COLUMNS]), ["provider", "source_id"])
        gone = delta.deletions(rows, known).select("instance_id").distinct().persist()
        if not gone.isEmpty():
            state = table.read()
            marked = state.join(gone.withColumn("_gone", F.lit(True)), "instance_id", "left").withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("deleted_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))).otherwise(F.col("deleted_at")))
            table.write(marked.select(state.columns))
        gone.unpersist()
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FILE_INSTANCE_COLUMNS = [c.strip().split(" ")[0] for c in FILE_INSTANCE.split(",")]


def on_arrival(mounts: DataFrame, known: Snapshots, act: Callable[[DataFrame], None], checkpoint: str, platform: str = "linux") -> StreamingQuery:
    """Calls act with the mount events of each batch of listings (mount_path), then remembers the mounts. An act that fails is
    called again with the same batch."""

    def batch(rows: DataFrame, _: int) -> None:
        before = known.read()
        if before is None:
            before = rows.sparkSession.createDataFrame([], "mount_path string, ord long")
        found = new_mounts(before, rows.select("mount_path"), platform)
        if not found.isEmpty():
            act(found)
            known.merge(rows.select("mount_path", F.lit(0).cast("long").alias("ord")), ["mount_path"])

    return mounts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def by_topic(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], None]], checkpoint: str, log: str | None = None) -> StreamingQuery:
    """Hands the events of each topic (event_type) to its sink, and all of them to a log."""

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        if log:
            rows.write.mode("append").json(log)
        for topic, sink in sinks.items():
            sink(rows.where(F.col("event_type") == topic))
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
