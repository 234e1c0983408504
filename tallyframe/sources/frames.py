"""Frames of a capturing device as a stream: any object with next_frame() -> bytes."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class FrameSource(Protocol):
    def next_frame(self) -> bytes:
        """The next frame; StopIteration when there are no more."""


class FrameReader(SimpleDataSourceStreamReader):
    """For one device on the driver's host; many go through sources.feed. Reads up to `batch` frames at a time. The offset is the number of frames taken; a source is opened at an offset, so that frames of a
    batch that is read again are the same if the device keeps them."""

    def __init__(self, open_at: Callable[[int], FrameSource], batch: int):
        self.open_at, self.batch = open_at, batch

    def initialOffset(self) -> dict:
        return {"taken": 0}

    def _take(self, start: int, most: int) -> list[tuple[int, bytes]]:
        source, out = self.open_at(start), []
        while len(out) < most:
            try:
                out.append((start + len(out), source.next_frame()))
            except StopIteration:
                break
        return out

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._take(start["taken"], self.batch)
        return iter(rows), {"taken": start["taken"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._take(start["taken"], end["taken"] - start["taken"]))


class FrameDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_source"

    def schema(self) -> str:
        return "seq long, payload binary"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return FrameReader(pickle.loads(bytes.fromhex(self.options["source"])), int(self.options.get("batch", 100)))


def frame_stream(spark: SparkSession, open_at: Callable[[int], FrameSource], batch: int = 100) -> DataFrame:
    """(seq, payload) of a source; open_at(n) gives a source whose next frame is number n."""
    spark.dataSource.register(FrameDataSource)
    return spark.readStream.format("frame_source").option("source", cloudpickle.dumps(open_at).hex()).option("batch", batch).load()
