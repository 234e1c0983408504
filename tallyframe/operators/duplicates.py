"""Duplicates: live instances with the same digest, size and MIME type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live(instances: DataFrame) -> DataFrame:
    return instances.where(F.col("deleted_at").isNull())


def duplicates_for_hash(instances: DataFrame, content_hash: str, size: int | None = None, mime_type: str | None = None) -> DataFrame:
    """Live instances of a digest, narrowed by size and MIME type if given."""
    found = live(instances).where(F.col("content_hash") == content_hash)
    for name, value in (("size", size), ("mime_type", mime_type)):
        if value is not None:
            found = found.where(F.col(name) == value)
    return found


def duplicate_groups(instances: DataFrame) -> DataFrame:
    """One row per group of two or more: key, n, first_ord, first canonical id. No list of members, so a group may be of any size."""
    groups = live(instances).groupBy("content_hash", "size", "mime_type")
    out = groups.agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.min("canonical_id").alias("canonical_id"), F.sort_array(F.collect_set("provider")).alias("providers"))
    return out.where("n > 1")


def members(instances: DataFrame) -> DataFrame:
    """The live instances that are in a group, a row each, with the group's n and first_ord."""
    key = ["content_hash", "size", "mime_type"]
    return live(instances).join(duplicate_groups(instances).select(*key, "n", "first_ord"), key)


def with_member_arrays(instances: DataFrame) -> DataFrame:
    """Groups with aligned arrays of instance ids, providers and paths, in order. For groups known to fit a row."""
    rows = F.sort_array(F.collect_list(F.struct("ord", "instance_id", "provider", "path")))
    out = live(instances).groupBy("content_hash", "size", "mime_type").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), rows.alias("m"), F.min("canonical_id").alias("canonical_id")).where("n > 1")
    return out.select("content_hash", "size", "mime_type", "n", "first_ord", "canonical_id", *(F.transform("m", _field(k)).alias(f"{k}s") for k in ("instance_id", "provider", "path")))


def _field(name: str):
    return lambda row: row[name]


def by_size(groups: DataFrame) -> DataFrame:
    """Largest groups first, the earlier first among equals."""
    return groups.orderBy(F.desc("n"), "first_ord")


def unify(instances: DataFrame, canonical_id: Column | str) -> tuple[DataFrame, DataFrame]:
    """(canonical, instances): the attributes of the first instance, and all with the canonical id. No instances: an error."""
    cid = F.lit(canonical_id) if isinstance(canonical_id, str) else canonical_id
    first = instances.agg(F.min_by(F.struct("content_hash", "size", "mime_type", "version_id"), "ord").alias("f"), F.count("*").alias("n"))
    canonical = first.select(
        cid.alias("canonical_id"),
        F.when(F.col("n") > 0, F.col("f.content_hash")).otherwise(F.raise_error(F.lit("instances cannot be empty"))).alias("content_hash"),
        F.col("f.size").alias("size"),
        F.col("f.mime_type").alias("mime_type"),
        F.col("f.version_id").alias("latest_version_id"),
    )
    return canonical, instances.withColumn("canonical_id", cid)


def unify_all(instances: DataFrame) -> DataFrame:
    """Every instance of a group with the id of the group's first instance as canonical id."""
    key = ["content_hash", "size", "mime_type"]
    first = live(instances).groupBy(*key).agg(F.min_by("instance_id", "ord").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    joined = instances.join(first, key, "left")
    return joined.withColumn("canonical_id", F.when(F.col("_n").isNotNull() & F.col("deleted_at").isNull(), F.col("_first")).otherwise(F.col("canonical_id"))).drop("_first", "_n")
