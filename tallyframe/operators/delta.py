"""Provider deltas and drift: events applied to known instances, and two inventories compared."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def strategy(cursor: Column) -> Column:
    """incremental if there is a cursor that is not empty, else full."""
    return F.when(F.coalesce(cursor, F.lit("")) != "", "incremental").otherwise("full")


def _or(a: Column, b: Column) -> Column:
    """a, or b if a is null or empty."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def _matched(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events with the provider's instance of their source. Every event meets the state before all of them."""
    current = last_by_key(known, "provider", "source_id").select(F.struct(*known.columns).alias("cur"))
    return events.join(current, (F.col("provider_id") == F.col("cur.provider")) & (F.col("source_id") == F.col("cur.source_id")), "left")


def deletions(events: DataFrame, known: DataFrame) -> DataFrame:
    """(ord, instance_id) of known instances that an event deletes."""
    return _matched(events.where("event_type = 'deleted'"), known).where("cur is not null").select("ord", F.col("cur.instance_id").alias("instance_id"))


def moves(events: DataFrame) -> DataFrame:
    """Events that move or rename, complete or not."""
    return events.where(F.col("event_type").isin("moved", "renamed"))


def upserts(events: DataFrame, known: DataFrame) -> DataFrame:
    """Instances as the other events leave them. Events without digest, size or MIME type give none; a new instance's id
    follows from provider, source and order. Deltas don't build on each other."""
    full = events.where(F.col("event_type").isin("new", "modified", "moved", "renamed") & F.col("content_hash").isNotNull() & F.col("size").isNotNull() & F.col("mime_type").isNotNull())
    fresh = F.concat(F.lit("n-"), F.sha2(F.concat_ws("|", "provider_id", "e.source_id", F.col("ord").cast("string")), 256))
    rows = _matched(full, known).select("*", F.struct(*events.columns).alias("e"))
    return rows.select(
        "ord",
        F.coalesce("cur.instance_id", fresh).alias("instance_id"),
        F.col("cur.canonical_id").alias("canonical_id"),
        F.col("cur.version_id").alias("version_id"),
        F.col("e.source_id").alias("source_id"),
        F.col("provider_id").alias("provider"),
        F.col("e.path").alias("path"),
        F.col("e.content_hash").alias("content_hash"),
        F.col("e.size").alias("size"),
        F.col("e.mime_type").alias("mime_type"),
        _or(F.col("e.modified_at"), F.coalesce("cur.modified_at", F.lit(""))).alias("modified_at"),
        F.col("cur.discovered_at").alias("discovered_at"),
        F.lit(None).cast("string").alias("deleted_at"),
        _or(F.col("e.device_id"), F.col("cur.device_id")).alias("device_id"),
    )


def reconcile(provider_id: str, snapshot: DataFrame, inventory: DataFrame) -> DataFrame:
    """(source_id, drift): missing_in_provider, missing_in_inventory or hash_mismatch. Only the inventory is narrowed to the provider."""
    theirs = last_by_key(snapshot.select("source_id", "content_hash", "ord"), "source_id").select("source_id", F.col("content_hash").alias("theirs"), F.lit(True).alias("there"))
    ours = inventory.where(F.col("provider") == provider_id).select("source_id", "content_hash", "ord")
    ours = last_by_key(ours, "source_id").select("source_id", F.col("content_hash").alias("ours"), F.lit(True).alias("here"))
    drift = F.when(F.col("there").isNull(), "missing_in_provider").when(F.col("here").isNull(), "missing_in_inventory").when(~F.col("theirs").eqNullSafe(F.col("ours")), "hash_mismatch")
    return theirs.join(ours, "source_id", "full_outer").select("source_id", drift.alias("drift")).where("drift is not null")


def sync_provider(spark: SparkSession, provider_id: str, cursor: str | None, fetch_full: Callable[[str], tuple[DataFrame, str | None]], fetch_more: Callable[[str, str], tuple[DataFrame, str | None]]) -> DataFrame:
    """One row (provider_id, strategy, event_count, new_cursor, duration_seconds) of a sync: what is after the cursor if there is one,
    else everything. The fetches return events as a DataFrame, and the next cursor."""
    began = time.perf_counter()
    rows, new = fetch_more(provider_id, cursor) if cursor else fetch_full(provider_id)
    n = rows.count()
    took = round(time.perf_counter() - began, 6)
    return spark.createDataFrame([(provider_id, "incremental" if cursor else "full", n, new, took)], "provider_id string, strategy string, event_count long, new_cursor string, duration_seconds double")


def sync_providers(states: DataFrame, fetch_full: Callable[[DataFrame], tuple[DataFrame, DataFrame]], fetch_more: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(provider_id, strategy, event_count, new_cursor) for each of states (provider_id, cursor): many providers as one job. A fetch gets the providers that are its and gives
    their events and their next cursors (provider_id, new_cursor); a provider without events has a count of 0, one without a next cursor keeps its own."""
    marked = states.select("provider_id", "cursor", strategy(F.col("cursor")).alias("strategy"))
    out = None
    for name, fetch in (("full", fetch_full), ("incremental", fetch_more)):
        own = marked.where(F.col("strategy") == name)
        events, cursors = fetch(own.select("provider_id", "cursor"))
        counted = events.groupBy("provider_id").agg(F.count("*").alias("event_count"))
        rows = own.join(counted, "provider_id", "left").join(cursors.select("provider_id", "new_cursor"), "provider_id", "left")
        rows = rows.select("provider_id", "strategy", F.coalesce("event_count", F.lit(0)).cast("long").alias("event_count"), F.coalesce("new_cursor", "cursor").alias("new_cursor"))
        out = rows if out is None else out.unionByName(rows)
    return out
