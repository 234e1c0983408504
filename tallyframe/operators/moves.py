"""Moves and copies between two snapshots, by digest and location.

A location is (provider, path, device); devices may be null and then equal each other. Per digest, what disappeared is
paired with what appeared in order; what exceeds the pairs is dropped. If nothing disappeared, each new location is a copy of
the digest's first earlier instance. Snapshots count with deleted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut, numbered

LOCATION = ("provider", "path", "device_id")
#: Rows of a digest in a snapshot that one task may number.
HOT_ROWS = 1_000_000


def _located(snapshot: DataFrame) -> DataFrame:
    """The last instance in each location of a digest, at the place of the first."""
    row = F.struct("ord", "instance_id", "canonical_id")
    last = snapshot.groupBy("content_hash", *LOCATION).agg(F.max_by(row, "ord").alias("r"))
    return last.select("content_hash", *LOCATION, "r.ord", "r.instance_id", "r.canonical_id")


def _gone(these: DataFrame, those: DataFrame) -> DataFrame:
    other = those.select("content_hash", *LOCATION).toDF("h", "p", "q", "d")
    same = (F.col("content_hash") == F.col("h")) & (F.col("provider") == F.col("p")) & (F.col("path") == F.col("q")) & F.col("device_id").eqNullSafe(F.col("d"))
    return these.join(other, same, "left_anti")


def _in_order(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with rn, their place among those of their digest. Digests that very many rows share (hot) are numbered by ranges of one sort, not by a task each."""
    order = Window.partitionBy("content_hash").orderBy("ord", *LOCATION)
    if hot is None:
        return rows.withColumn("rn", F.row_number().over(order))
    few = rows.join(F.broadcast(hot), "content_hash", "left_anti").withColumn("rn", F.row_number().over(order))
    many = numbered(rows.join(F.broadcast(hot), "content_hash", "left_semi"), "content_hash", "ord", *LOCATION, name="_place")
    first = F.broadcast(many.groupBy("content_hash").agg(F.min("_place").alias("_first")))  # a row for each hot digest
    return few.unionByName(many.join(first, "content_hash").withColumn("rn", (F.col("_place") - F.col("_first") + 1).cast("int")).select(*few.columns))


def detect(previous: DataFrame, current: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Move and copy events, event_type telling which. Event ids follow from what the event says. A digest with more than hot_rows rows in a snapshot is hot."""
    sizes = previous.select("content_hash", F.lit(1).alias("_p"), F.lit(0).alias("_c")).unionAll(current.select("content_hash", F.lit(0), F.lit(1)))
    hot = cut(sizes.groupBy("content_hash").agg(F.sum("_p").alias("_p"), F.sum("_c").alias("_c")).where((F.col("_p") > hot_rows) | (F.col("_c") > hot_rows)).select("content_hash"))
    hot = None if hot.isEmpty() else hot  # no more of them than rows divided by hot_rows
    before, now = _located(previous), _located(current)
    known = before.select("content_hash").distinct()
    gone = _gone(before, now).join(now.select("content_hash").distinct(), "content_hash", "left_semi")
    new = _gone(now, before).join(known, "content_hash", "left_semi")
    gone, new = _in_order(gone, hot), _in_order(new, hot)
    old = gone.select("content_hash", "rn", *(F.col(c).alias(f"from_{c}") for c in LOCATION))
    moved = new.join(old, ["content_hash", "rn"]).withColumn("event_type", F.lit("move"))
    anchor = previous.groupBy("content_hash").agg(F.min_by(F.struct(*LOCATION), "ord").alias("a")).select("content_hash", *(F.col(f"a.{c}").alias(f"from_{c}") for c in LOCATION))
    copied = new.join(gone.select("content_hash").distinct(), "content_hash", "left_anti").join(anchor, "content_hash").withColumn("event_type", F.lit("copy"))
    columns = ["canonical_id", "instance_id", "event_type", "content_hash", *(f"from_{c}" for c in LOCATION), *(F.col(c).alias(f"to_{c}") for c in LOCATION)]
    events = moved.select(*columns).unionByName(copied.select(*columns))
    key = F.concat_ws("|", "event_type", "content_hash", "from_provider", "from_path", F.coalesce("from_device_id", F.lit("")), "to_provider", "to_path", F.coalesce("to_device_id", F.lit("")))
    return events.withColumn("event_id", F.sha2(key, 256))


def apply_moves(instances: DataFrame, events: DataFrame) -> DataFrame:
    """Instances at their last move's new location; copies change nothing. events may have an order in ord."""
    order = F.col("ord") if "ord" in events.columns else F.lit(0)
    to = F.struct(*(F.col(f"to_{c}").alias(c) for c in LOCATION))
    last = events.where("event_type = 'move' and instance_id is not null").groupBy("instance_id").agg(F.max_by(to, order).alias("_to"))
    moved = instances.join(last, "instance_id", "left")
    return moved.select(*(F.when(F.col("_to").isNotNull(), F.col(f"_to.{c}")).otherwise(F.col(c)).alias(c) if c in LOCATION else F.col(c) for c in instances.columns))


def audit_log(events: DataFrame) -> DataFrame:
    from tallyframe.functions.paths import move_end

    return events.select("event_id", "event_type", "content_hash", move_end(F.col("from_provider"), F.col("from_path")).alias("from"), move_end(F.col("to_provider"), F.col("to_path")).alias("to"))
