import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import chat, postings
from tallyframe.sources import ranges as R


def odd(rng, depth=0):
    """A JSON value with quotes, backslashes and brackets in its strings."""
    text = lambda: "".join(rng.choice('ab"\\{}[],: \n\té') for _ in range(rng.randrange(9)))
    return rng.choice([text, lambda: rng.randrange(99), lambda: None, lambda: [odd(rng, depth + 1) for _ in range(rng.randrange(3))] if depth < 3 else 1, lambda: {text(): odd(rng, depth + 1) for _ in range(rng.randrange(3))} if depth < 3 else 2])()


@pytest.mark.parametrize("piece", [1, 7, 64, 5000])
def test_objects_of_any_piece(tmp_path, piece):
    rng = random.Random(piece)
    values = [{"k": i, "x": odd(rng)} for i in range(60)]
    mixed = [v for i, x in enumerate(values) for v in ([x] if i % 3 else [x, odd(rng) if not isinstance(odd(rng), dict) else 5])]
    mixed = [x for x in mixed if not isinstance(x, dict) or "k" in x]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(mixed, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])))
    size, found, inside, depth = path.stat().st_size, [], False, 0
    for a in range(0, size, piece):
        b = min(size, a + piece)
        found += [json.loads(x) for _, x in R.objects(str(path), a, b, inside, depth, False)]
        flip, out, within = R.summary(str(path), a, b)
        depth, inside = depth + (within if inside else out), inside ^ flip
    assert found == values and not inside and depth == 0


def test_read_array(spark, tmp_path):
    path = str(tmp_path / "big.json")
    rows = [{"k": i, "name": f'n"{i}\\', "more": {"z": [i, "]}"]}} for i in range(30_000)]
    with open(path, "w") as f:
        json.dump(rows, f)
    got = R.read_array(spark, path, "k long, name string", strict=True, piece=100_000)
    assert got.rdd.getNumPartitions() > 10 and got.select(F.spark_partition_id()).distinct().count() > 10
    assert [(r.k, r.name) for r in got.orderBy("ord").collect()] == [(r["k"], r["name"]) for r in rows]


def test_read_array_odd(spark, tmp_path):
    def read(text, **more):
        (tmp_path / "x.json").write_text(text)
        return [r.k for r in R.read_array(spark, str(tmp_path / "x.json"), "k long", piece=5, **more).orderBy("ord").collect()]

    assert read("[]", strict=True) == [] and read(" [ ] ", strict=True) == [] and read("") == []
    assert read('[{"k": 1}, 7, "{", [{"k": 5}], null, {"k": 2}, {"k": broken}, {"k": 3}]') == [1, 2, 3]
    assert read('[{"k": 1},\n{"k": 2}\n]\n', strict=True) == [1, 2]
    for bad in ("", '[{"k": 1}', '[{"k": 1}, 7]', '[{"k": 1}, "a"]', '[{"k": 1}, [2]]', '{"k": 1} x'):
        with pytest.raises(Exception, match="array"):
            read(bad, strict=True)


def test_last_lines(tmp_path, monkeypatch):
    p = tmp_path / "log"
    p.write_bytes(b"first\n" * 100_000 + b" second last\n\n" + b"x" * 300 + b"\n \n")
    read = []
    opened = R._file

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(n)
            return self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    monkeypatch.setattr(R, "_file", lambda path: Counted(opened(path)))
    assert R.last_lines(str(p), 1, block=100) == ["x" * 300] and sum(read) <= 500
    assert R.last_lines(str(p), 2, block=100) == ["second last", "x" * 300]
    p.write_bytes(b"")
    assert R.last_lines(str(p)) == []
    p.write_bytes(b"one")
    assert R.last_lines(str(p), 3) == ["one"] and R.last_lines(str(p), 3, block=1) == ["one"]


def test_postings(spark, tmp_path):
    rng = random.Random(3)
    words = ["The", "und", "please", "röd", "x", "y", "z"]
    rows = [(f"m{i:04d}", " ".join(rng.choice(words) for _ in range(rng.randrange(6))) if i % 50 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "message_id string, body_text string")
    at = str(tmp_path / "p")
    postings.write(df, at)
    for wanted in (["the", "PLEASE", "und"], ["röd"], ["nowhere"], ["x", "x"], []):
        want = [tuple(r) for r in chat.search(df, wanted, k=30).select("message_id", "score").collect()]
        assert [tuple(r) for r in postings.search(spark, at, wanted, k=30).collect()] == want
    assert {r.word: r.messages for r in postings.frequencies(spark, at, ["The", "x"]).collect()} == {w: sum(w in (t or "").lower().split() for _, t in rows) for w in ("the", "x")}
    found = postings.search(spark, at, ["please"], 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:60]
    assert "PushedFilters: [" in plan and "word" in plan.split("PushedFilters")[1][:80]
