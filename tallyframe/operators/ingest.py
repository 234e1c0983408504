"""Manifests into graph rows and into the inventory's tables.

Missing and null keys of a record count alike: a record is an error if a required key is not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.ids import embed_text
from tallyframe.operators.graph import numbered
from tallyframe.operators.merge import merge
from tallyframe.operators.versions import next_numbers
from tallyframe.plans.schemas import RECORD_KEYS


def missing_keys(keys: tuple[str, ...] = RECORD_KEYS) -> Column:
    """The required keys that a record lacks, sorted."""
    return F.array_compact(F.array(*(F.when(F.col(k).isNull(), F.lit(k)) for k in sorted(keys))))


def ordered(records: DataFrame) -> DataFrame:
    return records.orderBy(F.coalesce("uuid7", F.lit("")), F.coalesce("path", F.lit("")))


def placed(records: DataFrame) -> DataFrame:
    """records with their place in that order, from 0, for inventories of any size."""
    return numbered(records, F.coalesce("uuid7", F.lit("")), F.coalesce("path", F.lit("")), name="place")


def good(records: DataFrame) -> DataFrame:
    return records.where(F.size(missing_keys()) == 0)


def errors(records: DataFrame) -> DataFrame:
    """(record, error) of records with keys missing."""
    bad = records.withColumn("_m", missing_keys()).where(F.size("_m") > 0)
    return bad.select(F.coalesce("uuid7", F.lit("unknown")).alias("record"), F.concat(F.lit("record missing keys: "), F.array_join("_m", ", ")).alias("error"))


def distinct_records(records: DataFrame) -> DataFrame:
    """Good records, the first by path of those with one id and digest."""
    first = Window.partitionBy("uuid7", "blake3").orderBy("path", "category", "mime_type")
    return good(records).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def nodes(records: DataFrame, distinct: bool = True) -> DataFrame:
    rows = distinct_records(records) if distinct else good(records)
    canonical = F.coalesce("canonical_path", F.lit("")) if "canonical_path" in records.columns else F.lit("")
    return rows.select("uuid7", "path", canonical.alias("canonical_path"), F.col("blake3").alias("hash"), "category", "mime_type")


def edges(records: DataFrame, distinct: bool = True) -> DataFrame:
    return nodes(records, distinct).select(F.col("uuid7").alias("source"), F.col("hash").alias("target"), F.lit("HAS_HASH").alias("edge_type"))


def embeddings(records: DataFrame, distinct: bool = True) -> DataFrame:
    """Of each good record's path."""
    return nodes(records, distinct).select(F.sha2("path", 256).alias("identifier"), embed_text(F.col("path")).alias("vector"))


def sync_embeddings(records: DataFrame) -> DataFrame:
    """Of every record's path, good or not; no path is the empty path."""
    path = F.coalesce("path", F.lit(""))
    return records.select(F.sha2(path, 256).alias("identifier"), embed_text(path).alias("vector"))


def dry_run(records: DataFrame) -> DataFrame:
    """One row: what an ingestion would process."""
    n = distinct_records(records).agg(F.count("*").alias("processed_records"))
    return n.join(errors(records).agg(F.count("*").alias("error_count")), F.lit(True)).select((F.col("processed_records") > 0).alias("graph_integration"), "processed_records", "error_count")


def table_rows(records: DataFrame, batch_id: str, versions: DataFrame) -> dict[str, DataFrame]:
    """The rows that a batch of records (with ord) adds to each table; versions: what exists, (file_id, version_number).
    Version ids follow from batch and order."""
    rows = records.withColumn("file_id", F.col("uuid7")).withColumn("version_id", F.sha2(F.concat_ws("/", F.lit(batch_id), F.col("ord").cast("string")), 256))
    numbered = next_numbers(versions, rows)
    hashes = rows.select(F.col("hash_algorithm").alias("algorithm"), F.col("blake3").alias("digest"), "size", "ord").where("digest is not null")
    second = rows.where("sha256 is not null and sha256 <> ''").select(F.lit("sha256").alias("algorithm"), F.col("sha256").alias("digest"), "size", "ord")
    return {
        "files": rows.select(F.col("file_id").alias("id"), "path", "source", F.col("blake3").alias("canonical_hash"), "category", "mime_type", "shortcut_allowed", F.col("version_id").alias("current_version_id"), "ord"),
        "hashes": hashes.unionByName(second),
        "versions": numbered.select(F.col("version_id").alias("id"), "file_id", F.lit(batch_id).alias("batch_id"), "version_number", F.col("blake3").alias("digest"), "size", "mtime", "mode"),
        "locations": rows.select("file_id", "version_id", "path", "source", F.lit(False).alias("is_canonical")),
        "metadata": rows.select("version_id", F.to_json(F.struct("size", "mtime", "mode")).alias("data")),
        "classifications": rows.select("version_id", "category", "mime_type", "shortcut_allowed"),
    }


def upsert_files(files: DataFrame, arriving: DataFrame) -> DataFrame:
    return merge(files, arriving, ["id"], untouched=tuple(c for c in ("created_at", "updated_at") if c in files.columns))


def upsert_hashes(hashes: DataFrame, arriving: DataFrame) -> DataFrame:
    return merge(hashes, arriving, ["algorithm", "digest"])


def batch_row(spark, batch_id: str, source: str, generated_at: str, status: str = "pending") -> DataFrame:
    if status not in ("pending", "complete"):
        raise ValueError(status)
    return spark.range(1).select(F.lit(batch_id).alias("id"), F.lit(source).alias("source"), F.lit(generated_at).alias("generated_at"), F.lit(status).alias("status"))


def violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has nothing to point at."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def complete_batches(batches: DataFrame, done: DataFrame) -> DataFrame:
    """batches with the status complete for those named in done (id)."""
    marked = batches.join(done.select("id").distinct().withColumn("_done", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("_done"), "complete").otherwise(F.col("status"))).select(batches.columns)


def file_shapes(nodes: DataFrame, edges: DataFrame, versions: DataFrame, shortcuts: DataFrame) -> DataFrame:
    """nodes (uuid7, hash, canonical_path, metadata) with what belongs to each as arrays of structs: relationships (source, target,
    edge_type), versions (id, version_number) and shortcuts (path, target_path), each in order and empty if there is none.
    For files whose versions fit a row."""

    def of(rows: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
        return rows.groupBy(F.col(key).alias("uuid7")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    out = nodes.join(of(edges, "source", "relationships", ["source", "target", "edge_type"]), "uuid7", "left")
    out = out.join(of(versions, "file_id", "versions", ["version_number", "id"]), "uuid7", "left").join(of(shortcuts, "file_id", "shortcuts", ["path", "target_path"]), "uuid7", "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("relationships", "versions", "shortcuts")})


def store_rows(records: DataFrame, batch_id: str, root: str) -> tuple[DataFrame, DataFrame]:
    """(store, shortcuts) that a batch of records (with ord) adds: one row for each record with a digest, (file_id, version_id, hash,
    canonical_path, verified), and one for each of them that has a path and may have a shortcut, (file_id, version_id, shortcut_path,
    target_path, shortcut_kind)."""
    rows = records.where("blake3 is not null").select(
        F.col("uuid7").alias("file_id"), F.sha2(F.concat_ws("/", F.lit(batch_id), F.col("ord").cast("string")), 256).alias("version_id"), F.col("blake3").alias("hash"), F.concat(F.lit(root.rstrip("/") + "/"), "blake3").alias("canonical_path"), "path", "shortcut_allowed", "ord"
    )
    store = rows.select("file_id", "version_id", "hash", "canonical_path", F.lit(True).alias("verified"), "ord")
    some = rows.where("path is not null and shortcut_allowed")
    return store, some.select("file_id", "version_id", F.col("path").alias("shortcut_path"), F.col("canonical_path").alias("target_path"), F.lit("symlink").alias("shortcut_kind"), "ord")


def upsert_store(store: DataFrame, arriving: DataFrame) -> DataFrame:
    return merge(store, arriving, ["canonical_path"])


def upsert_shortcuts(shortcuts: DataFrame, arriving: DataFrame) -> DataFrame:
    return merge(shortcuts, arriving, ["shortcut_path"])
