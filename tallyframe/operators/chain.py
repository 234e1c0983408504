"""Audit chains: each event's hash covers what it records and the hash of the event before it in its session."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.digests import canonical_json, digest


def payload(previous: Column) -> Column:
    """What an event's hash covers, as canonical JSON: the event's id is not part of it, its frame's is."""
    return canonical_json(timestamp_uuid7=F.col("timestamp_uuid7"), blake3_hash=F.col("content_hash"), frame_id=F.col("frame_id"), previous_event_hash=previous)


def with_expected(events: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Events with rn, the hash before (as stored in the row before) and expected, what the event's hash should be."""
    in_session = Window.partitionBy("session_id").orderBy("seq")
    rows = events.withColumn("rn", F.row_number().over(in_session)).withColumn("before", F.lag("event_hash").over(in_session))
    return rows.withColumn("expected", digest(payload(F.col("before")), algorithm))


def verify(events: DataFrame, strict: bool = False, algorithm: str = "sha256") -> DataFrame:
    """(session_id, n, chain_valid, valid_prefix). strict: the stored previous_event_hash has to agree too."""
    rows = with_expected(events, algorithm)
    bad = F.coalesce(F.col("event_hash") != F.col("expected"), F.lit(True))
    if strict:
        bad = bad | ~F.col("previous_event_hash").eqNullSafe(F.col("before"))
    out = rows.withColumn("bad", bad).groupBy("session_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("bad"), F.col("rn") - 1)).alias("first_bad"))
    return out.select("session_id", "n", F.col("first_bad").isNull().alias("chain_valid"), F.coalesce("first_bad", "n").cast("long").alias("valid_prefix"))


def _hash(algorithm: str, body: bytes) -> str:
    return hashlib.sha256(body).hexdigest() if algorithm == "sha256" else hashlib.blake2b(body, digest_size=32).hexdigest()


def build(records: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Chains for records (session_id, seq, timestamp_uuid7, content_hash, frame_id). Events of a session follow one another, so
    a session is one task's work; sessions are spread. Spark sorts them, on disk if need be, and Python holds one batch and the
    last hash, so a session may have any length. Equal seq are ordered by the other columns; a null seq comes last."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, previous = (), None  # no session is equal to ()
        for batch in batches:
            before, hashes = [], []
            for r in batch.to_pylist():
                if r["session_id"] != session:
                    session, previous = r["session_id"], None
                body = {"blake3_hash": r["content_hash"], "frame_id": r["frame_id"], "previous_event_hash": previous, "timestamp_uuid7": r["timestamp_uuid7"]}
                before.append(previous)
                previous = _hash(algorithm, json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode())
                hashes.append(previous)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[c.split()[0] for c in schema.split(", ")])

    schema = "session_id string, seq long, timestamp_uuid7 string, content_hash string, frame_id string, previous_event_hash string, event_hash string"
    rows = records.select("session_id", F.col("seq").cast("long").alias("seq"), "timestamp_uuid7", "content_hash", "frame_id")
    in_order = rows.repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_last("seq"), "timestamp_uuid7", "content_hash", "frame_id")
    return in_order.mapInArrow(of, schema)


def frame_tables(frames: DataFrame, provider: str = "recorder", algorithm: str = "sha256") -> dict[str, DataFrame]:
    """The rows that captured frames (session_id, device_id, seq, payload, mime_type, captured_ms) give in each table.
    Ids follow from session and sequence."""
    from tallyframe.functions.ids import id_at

    key = F.concat_ws("/", "session_id", F.col("seq").cast("string"))
    base = frames.select(
        "session_id", "device_id", "seq", "mime_type", digest(F.col("payload"), algorithm).alias("content_hash"), F.length("payload").cast("long").alias("size"), id_at(F.col("captured_ms"), key).alias("timestamp_uuid7"),
        *(F.sha2(F.concat(F.lit(f"{kind}/"), key), 256).alias(f"{kind}_id") for kind in ("canonical", "version", "instance", "frame")),
        F.concat_ws(":", "device_id", F.col("seq").cast("string")).alias("source_id"), F.concat(F.lit(f"{provider}://"), F.col("device_id"), F.lit("/"), F.col("seq").cast("string")).alias("path"),
    )
    content = ["content_hash", "size", "mime_type"]
    return {
        "canonical": base.select("canonical_id", *content, F.col("version_id").alias("latest_version_id")),
        "version": base.select("version_id", "canonical_id", F.lit(None).cast("string").alias("parent_version_id"), "content_hash", "size", F.lit(provider).alias("provider"), "path"),
        "instance": base.select("instance_id", "canonical_id", "version_id", "source_id", F.lit(provider).alias("provider"), "path", *content, "device_id"),
        "frame": base.select("frame_id", "session_id", "seq", "timestamp_uuid7", "content_hash", F.col("size").alias("bytes_size"), F.col("canonical_id").alias("canonical_file_id"), "version_id", "mime_type"),
        "event": build(base.select("session_id", "seq", "timestamp_uuid7", "content_hash", "frame_id"), algorithm),
    }


def sessions(events: DataFrame, stopped: DataFrame | None = None) -> DataFrame:
    """(session_id, frame_count, state): stopped for the sessions named in stopped, else running."""
    out = events.groupBy("session_id").agg(F.count("*").alias("frame_count"))
    if stopped is None:
        return out.withColumn("state", F.lit("running"))
    return out.join(stopped.select("session_id", F.lit("stopped").alias("_s")), "session_id", "left").withColumn("state", F.coalesce("_s", F.lit("running"))).drop("_s")


def bundle(session_rows: DataFrame, frames: DataFrame, events: DataFrame) -> DataFrame:
    """A row per frame and event of each session, with whether the session's chain is valid."""
    checked = verify(events).select("session_id", "chain_valid")
    rows = frames.join(events.select("session_id", "seq", "event_hash", "previous_event_hash"), ["session_id", "seq"], "left")
    return session_rows.join(checked, "session_id", "left").join(rows, "session_id", "left").withColumn("chain_valid", F.coalesce("chain_valid", F.lit(True)))


def recorder_states(log: DataFrame) -> DataFrame:
    """One row per session from its log (session_id, seq, kind: start, stop, frame or error, at, detail): state, started_at, stopped_at,
    frame_count, starts and last_error.

    A start while running changes nothing; another one begins a run and clears the error. Frames count while it runs. An error
    ends the capture and stays until the next start; the state is running until a stop is logged, as a recorder says it.
    A session without a start is stopped."""
    w = Window.partitionBy("session_id").orderBy("seq")
    turn = F.when(F.col("kind").isin("start", "stop", "error"), F.col("kind"))
    before = F.last(turn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = log.withColumn("_before", before)
    begins = (F.col("kind") == "start") & (F.coalesce("_before", F.lit("stop")) != "start")
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    out = rows.groupBy("session_id").agg(
        last("kind", F.col("kind").isin("start", "stop")).alias("_last"),
        F.max(F.when(begins, F.col("at"))).alias("started_at"),
        last("at", F.col("kind").isin("stop", "start")).alias("_at"),
        F.count_if((F.col("kind") == "frame") & (F.col("_before") == "start")).alias("frame_count"),
        F.count_if(begins).alias("starts"),
        F.max(F.when(F.col("kind") == "error", F.struct("seq", "detail"))).alias("_error"),
        F.max(F.when(begins, F.col("seq"))).alias("_begun"),
    )
    running = F.coalesce(F.col("_last") == "start", F.lit(False))
    error = F.when(F.col("_begun").isNull() | (F.col("_error.seq") > F.col("_begun")), F.col("_error.detail"))
    return out.select("session_id", F.when(running, "running").otherwise("stopped").alias("state"), "started_at", F.when(~running, F.col("_at")).alias("stopped_at"), "frame_count", "starts", error.alias("last_error"))
