"""Audit chains over a stream: per session only the last hash and its number are kept as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyframe.operators.chain import _hash

OUT = "session_id string, seq long, timestamp_uuid7 string, content_hash string, frame_id string, previous_event_hash string, event_hash string"


def chained(records: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Events for a stream of records (session_id, seq, timestamp_uuid7, content_hash, frame_id); sequence numbers within a batch are
    followed in order, and one that is not above the last is dropped as a repeat."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, -1)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples(index=False):
            if r.seq <= at:
                continue
            body = {"blake3_hash": r.content_hash, "frame_id": r.frame_id, "previous_event_hash": last, "timestamp_uuid7": r.timestamp_uuid7}
            h = _hash(algorithm, json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode())
            out.append((key[0], r.seq, r.timestamp_uuid7, r.content_hash, r.frame_id, last, h))
            last, at = h, int(r.seq)
        state.update((last, at))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    rows = records.select("session_id", "seq", "timestamp_uuid7", "content_hash", "frame_id")
    return rows.groupBy("session_id").applyInPandasWithState(step, OUT, "last string, at long", "append", GroupStateTimeout.NoTimeout)


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append-only sink; there is no way to change what is written."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
