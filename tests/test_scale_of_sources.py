import json
import os

from pyspark.sql import functions as F

from tallyframe.plans import scans
from tallyframe.sources import feed, walk
from tallyframe.streaming.recorder import Recorder


def test_a_feed_lists_only_what_a_piece_needs(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "feed")
    feed.FolderFeed.write(spark.range(95).select(F.lit("p").alias("provider"), F.col("id").alias("number"), F.col("id").alias("v")), at, 10)
    f = feed.FolderFeed(at, 10, ("v",))
    monkeypatch.setattr(feed.FolderFeed, "_files", None)  # lists the whole provider
    assert [v for (v,) in f.events("p", 17, 42)] == list(range(17, 42))


def test_pieces_do_not_grow_in_number(monkeypatch):
    monkeypatch.setattr(feed, "PIECES", 10)
    parts = feed.FeedReader(None, 0, 3).partitions({"p": 5}, {"p": 1000, "q": 7})
    assert len(parts) <= 12 and [(parts[0].start, parts[-1].provider, parts[-1].end)] == [(5, "q", 7)]
    assert sum(x.end - x.start for x in parts) == 1002


def test_a_session_has_one_timer():
    class Handle:
        timers: list = []
        listTimers = lambda self: list(self.timers)
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.append(t)

    class State:
        rows: list = []
        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

    class At:
        def __init__(self, t):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: t

    import pandas as pd

    r = Recorder(10)
    r.handle, r.runs = Handle(), State()
    list(r.handleInputRows(("a",), iter([pd.DataFrame({"at": [0, 50, 100]})]), At(0)))
    assert r.handle.timers == [10]
    r.handle.timers.clear()
    (done,) = r.handleExpiredTimer(("a",), At(70), At(10))
    assert done["started"].tolist() == [0, 50] and r.handle.timers == [110] and r.runs.rows == [(100, 100, 1)]


def test_stream_files_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scans, "A_FILE", 100)
    _, at = scans._stream(spark, spark.range(1000))
    assert len([n for n in os.listdir(at.removeprefix("file:")) if n.endswith(".json")]) == 10


def test_files_of_one_folder_are_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "one").mkdir()
    for k in range(60):
        (tmp_path / "one" / f"{k}.txt").write_text(json.dumps(k))
    files = walk.walk(spark, str(tmp_path), ())
    got = walk.digested(files)
    whole = walk.walk(spark, str(tmp_path), (), digest="sha256").select("path", F.col("sha256").alias("digest"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    assert files.select(F.spark_partition_id()).distinct().count() == 1 and got.select(F.spark_partition_id()).distinct().count() > 1
