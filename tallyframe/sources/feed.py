"""A stream source with offsets for each provider, whose events are read in tasks.

A feed is any object that knows its providers, how far each has come, and the events between two places of one (Feed). The driver only handles a number for each
provider; a batch is cut into partitions of bounded size, and each is read by the task that needs it.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


#: Pieces that a batch is cut into at most, beside one for each provider.
PIECES = 1000


class Feed(Protocol):
    def ends(self) -> dict[str, int]:
        """How many events each provider has."""

    def events(self, provider: str, start: int, end: int) -> Iterator[tuple]:
        """Events number start to end of a provider, as rows of the schema after (provider, number). The same each time."""

    def done(self, ends: dict[str, int]) -> None:
        """Told when all events before these places have been taken for good."""


class Piece(InputPartition):
    def __init__(self, provider: str, start: int, end: int):
        super().__init__(f"{provider}:{start}:{end}")
        self.provider, self.start, self.end = provider, start, end


class FeedReader(DataSourceStreamReader):
    """Offsets are how many events of each provider have been read. A batch takes no more than `most` of a provider, in pieces of `piece`."""

    def __init__(self, feed: Feed, most: int, piece: int):
        self.feed, self.most, self.piece, self.at = feed, most, piece, None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """No further than `most` beyond what was last planned; a restarted reader learns that place from the first partitions or commit."""
        ends = self.feed.ends()
        before = self.at or {}
        return {p: min(n, before.get(p, 0) + self.most) if self.most else n for p, n in sorted(ends.items())}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """Pieces of `piece` events, or of more where there would be over PIECES of them; their rows are read one by one."""
        self.at = end
        piece = max(self.piece, -(-sum(max(0, n - start.get(p, 0)) for p, n in end.items()) // PIECES))
        return [Piece(p, a, min(a + piece, n)) for p, n in end.items() for a in range(start.get(p, 0), n, piece)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        for k, row in enumerate(self.feed.events(partition.provider, partition.start, partition.end)):
            yield (partition.provider, partition.start + k, *row)

    def commit(self, end: dict) -> None:
        self.at = end
        self.feed.done(end)


class FeedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_feed"

    def schema(self) -> str:
        return "provider string, number long, " + self.options["fields"]

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(pickle.loads(bytes.fromhex(self.options["feed"]))(), int(self.options["most"]), int(self.options["piece"]))


def stream(spark: SparkSession, open_feed: Callable[[], Feed], fields: str, most: int = 0, piece: int = 10_000) -> DataFrame:
    """(provider, number, fields) of a feed. most: events of a provider that a batch takes, 0 for all that there are."""
    spark.dataSource.register(FeedDataSource)
    return spark.readStream.format("provider_feed").option("feed", cloudpickle.dumps(open_feed).hex()).option("fields", fields).option("most", most).option("piece", piece).load()


class FolderFeed:
    """A feed of folders, one for each provider (provider=name), with files of JSON lines in it or in folders below, whose paths are in their order and which hold `size` events each,
    the last one maybe fewer. Paths are opened with pyarrow's file systems, on the driver and in tasks alike; `write` makes such folders."""

    def __init__(self, folder: str, size: int, fields: tuple[str, ...]):
        self.folder, self.size, self.fields = folder, size, fields

    @staticmethod
    def write(events: DataFrame, folder: str, size: int) -> None:
        """events (provider, number from 0 in each, fields), a file for each `size` of a provider's, written by tasks."""
        part = F.lpad(F.floor(F.col("number") / size).cast("string"), 12, "0")
        dealt = events.withColumn("part", part).repartition("provider", "part").sortWithinPartitions("provider", "part", "number")
        dealt.drop("number").write.partitionBy("provider", "part").json(folder)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def _files(self, provider: str) -> list[str]:
        from pyarrow import fs

        store, at = self._store()
        return sorted(i.path for i in store.get_file_info(fs.FileSelector(f"{at}/provider={provider}", allow_not_found=True, recursive=True)) if i.is_file and i.base_name.endswith(".json") and i.size)

    def _lines(self, path: str) -> list[bytes]:
        store, _ = self._store()
        with store.open_input_stream(path) as f:
            return f.read().splitlines()

    def ends(self) -> dict[str, int]:
        from pyarrow import fs

        store, at = self._store()
        names = [i.base_name.removeprefix("provider=") for i in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if i.base_name.startswith("provider=")]
        out = {}
        for p in names:
            if files := self._files(p):
                out[p] = (len(files) - 1) * self.size + len(self._lines(files[-1]))
        return out

    def _place(self, provider: str, k: int, listed: list[str]) -> str:
        """File number k of a provider. Where `write` has made a folder for it, that alone is listed; else all files are, once for a piece."""
        from pyarrow import fs

        store, at = self._store()
        own = [i.path for i in store.get_file_info(fs.FileSelector(f"{at}/provider={provider}/part={k:012d}", allow_not_found=True)) if i.is_file and i.base_name.endswith(".json") and i.size]
        if len(own) == 1:
            return own[0]
        if not listed:
            listed += self._files(provider)
        return listed[k]

    def events(self, provider: str, start: int, end: int) -> Iterator[tuple]:
        listed: list[str] = []
        for k in range(start // self.size, -(-end // self.size)):
            for n, line in enumerate(self._lines(self._place(provider, k, listed))):
                if start <= k * self.size + n < end:
                    row = json.loads(line)
                    yield tuple(row.get(f) for f in self.fields)

    def done(self, ends: dict[str, int]) -> None:
        """Nothing is thrown away."""
