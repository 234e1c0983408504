"""Versions: what kind of change a pair shows, numbers, lineage and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds of change.
UNCHANGED, NEW_LOCATION, NEW_VERSION, NEW_OBJECT = "unchanged", "same_version_new_location", "new_version_same_path", "new_canonical_object"


def change_type(old: str = "old", new: str = "new") -> Column:
    """For struct columns of two instances. A null side makes the objects differ."""
    same = lambda *names: F.forall(F.array(*(F.coalesce(F.col(f"{old}.{n}") == F.col(f"{new}.{n}"), F.lit(False)) for n in names)), lambda x: x)
    content, place = same("content_hash", "size"), same("path", "provider")
    return F.when(content & place, UNCHANGED).when(content, NEW_LOCATION).when(place, NEW_VERSION).otherwise(NEW_OBJECT)


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """pairs: structs old and new. Adds change_type and canonical_id, null for a new object."""
    kind = change_type()
    return pairs.withColumn("change_type", kind).withColumn("canonical_id", F.when(F.col("change_type") != NEW_OBJECT, F.col("old.canonical_id")))


def next_numbers(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """arriving (file_id, ord) with version_number counting on from the largest that exists for the file."""
    top = existing.groupBy("file_id").agg(F.max("version_number").alias("_top"))
    order = Window.partitionBy("file_id").orderBy("ord")
    return arriving.join(top, "file_id", "left").withColumn("version_number", (F.coalesce("_top", F.lit(0)) + F.row_number().over(order)).cast("int")).drop("_top")


def link(versions: DataFrame) -> DataFrame:
    """Each version with the one before it, by time and order, as parent."""
    order = Window.partitionBy("canonical_id").orderBy("created_at", "ord")
    return versions.withColumn("parent_version_id", F.lag("version_id").over(order))


def link_pairs(pairs: DataFrame, canonical_id: Column) -> DataFrame:
    """pairs: structs old and new. The new version as a child of the old; an error if either is of another lineage."""
    checked = canonical_id
    for side in ("old", "new"):
        checked = F.when(F.col(f"{side}.canonical_id") == canonical_id, checked).otherwise(F.raise_error(F.lit(f"{side} version is of another lineage")))
    return pairs.select(checked.alias("canonical_id"), F.col("new.version_id").alias("version_id"), F.col("old.version_id").alias("parent_version_id"))


def depths(versions: DataFrame, rounds: int = 64) -> DataFrame:
    """(version_id, root_id, depth) along parents, by doubling: each round looks twice as far up, so long chains take few rounds.
    A cycle is an error."""
    out = versions.select("version_id", F.coalesce("parent_version_id", "version_id").alias("up"), F.when(F.col("parent_version_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    known = versions.select(F.col("version_id").alias("v"))
    out = out.join(known, F.col("up") == F.col("v"), "left").select("version_id", F.coalesce("v", "version_id").alias("up"), F.when(F.col("v").isNull(), 0).otherwise(F.col("depth")).alias("depth"))
    from tallyframe.operators.graph import cut

    out = cut(out)
    for _ in range(rounds):
        above = out.select(F.col("version_id").alias("v"), F.col("up").alias("next"), F.col("depth").alias("more"))
        out = cut(out.join(above, F.col("up") == F.col("v")).select("version_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("_moved")))
        if out.where("_moved").isEmpty():
            return out.select("version_id", F.col("up").alias("root_id"), "depth")
        out = out.drop("_moved")
    raise ValueError("versions form a cycle")


def history(versions: DataFrame) -> DataFrame:
    """One row per version with its place in the lineage and the lineage's length."""
    by = Window.partitionBy("canonical_id")
    return versions.withColumn("position", F.row_number().over(by.orderBy("created_at", "ord"))).withColumn("version_count", F.count("*").over(by))


def history_of(versions: DataFrame, canonical_id: str) -> DataFrame:
    """One row: the lineage as an array in order of time. For one object."""
    names = ["version_id", "parent_version_id", "created_at", "provider", "path", "content_hash", "size"]
    rows = F.sort_array(F.collect_list(F.struct("created_at", "ord", F.struct(*names).alias("v"))))
    return versions.where(F.col("canonical_id") == canonical_id).agg(F.lit(canonical_id).alias("canonical_id"), F.count("*").alias("version_count"), F.transform(rows, lambda r: r["v"]).alias("lineage"))
