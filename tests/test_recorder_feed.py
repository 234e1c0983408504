import json

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import feed as S
from tallyframe.streaming import recorder as R


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


@pytest.fixture()
def store(spark):
    before = spark.conf.get(R.STORE[0], None)
    spark.conf.set(*R.STORE)
    yield
    spark.conf.unset(R.STORE[0]) if before is None else spark.conf.set(R.STORE[0], before)


def closed(rows, silence, until):
    """Runs whose silence has passed by `until` (seconds)."""
    out = []
    for s in {s for s, _ in rows}:
        run = []
        for t in [*sorted(t for x, t in rows if x == s), None]:
            if run and (t is None or t - run[-1] >= silence):
                if run[-1] + silence <= until:
                    out.append((s, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    return sorted(out)


def test_silent_sessions_are_stopped_by_timers(spark, store, tmp_path):
    batches = [[("a", 0), ("a", 5), ("b", 3), ("c", 9)], [("a", 8), ("a", 30), ("b", 100)], [("b", 101), ("a", 130), ("a", 95)], [("z", 400)]]
    at, out = tmp_path / "in", str(tmp_path / "out")
    at.mkdir()

    def run():
        frames = spark.readStream.schema("session_id string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(at))
        finish(R.sessions(frames, "10 seconds", "20 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        return sorted((r.session_id, r.started // 1000, r.stopped // 1000, r.frames) for r in spark.read.parquet(out).collect())

    seen = []
    for k, rows in enumerate(batches):  # a restart from the checkpoint for each
        (at / f"{k}.json").write_text("\n".join(json.dumps({"session_id": s, "ts": f"2024-01-01T00:{t // 60:02d}:{t % 60:02d}Z"}) for s, t in rows) + '\n{"session_id": null, "ts": "2024-01-01T00:00:00Z"}')
        got = [(s, a - 1704067200, b - 1704067200, n) for s, a, b, n in run()]
        seen += rows
        assert got == closed(seen, 10, max(t for _, t in seen) - 20)
    assert len(got) == 7


def test_folding_runs():
    import numpy as np

    r = R.Recorder(10)
    runs = r._folded([], np.array([50, 0, 9]))
    assert runs == [(0, 9, 2), (50, 50, 1)]
    assert r._folded(runs, np.array([18, 41, 27, 35])) == [(0, 50, 7)]
    assert r._folded(runs, np.array([], int)) == runs


def put(folder, provider, numbers, size):
    at = folder / f"provider={provider}"
    at.mkdir(parents=True, exist_ok=True)
    for k in range(0, len(numbers), size):
        (at / f"{k // size:06d}.json").write_text("\n".join(json.dumps({"v": v, "t": f"{provider}{v}"}) for v in numbers[k : k + size]))


def test_feed_reads_in_pieces_and_goes_on(spark, tmp_path):
    folder = str(tmp_path / "feed")
    put(tmp_path / "feed", "p", list(range(25)), 10)
    put(tmp_path / "feed", "q", list(range(3)), 10)

    def run():
        rows = S.stream(spark, lambda f=folder: S.FolderFeed(f, 10, ("v", "t")), "v long, t string", most=8, piece=3)
        finish(rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        return spark.read.parquet(str(tmp_path / "out"))

    want = lambda p, q: sorted([("p", k, k, f"p{k}") for k in range(p)] + [("q", k, k, f"q{k}") for k in range(q)])
    for _ in range(4):
        got = sorted(map(tuple, run().collect()))
    assert got == want(25, 3)
    put(tmp_path / "feed", "p", list(range(31)), 10)
    put(tmp_path / "feed", "r", [], 10)
    assert sorted(map(tuple, run().collect())) == want(31, 3)
    reader = S.FeedReader(S.FolderFeed(folder, 10, ("v",)), 8, 3)
    pieces = reader.partitions({"p": 2}, {"p": 10, "q": 3})
    assert [(x.provider, x.start, x.end) for x in pieces] == [("p", 2, 5), ("p", 5, 8), ("p", 8, 10), ("q", 0, 3)]
    assert reader.latestOffset() == {"p": 18, "q": 3}
    assert [list(reader.read(x)) for x in pieces[2:3]] == [[("p", 8, 8), ("p", 9, 9)]]
