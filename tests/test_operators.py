"""Literal scenarios, small enough to be seen through."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import classify, digests, ids, paths, perceptual, times, vectors
from tallyframe.operators import chain, chat, delta, duplicates, graph, ingest, lookup, merge, moves, reporting, similarity, status, versions
from tallyframe.plans import schemas


def instances(spark, rows):
    """rows: (source_id, provider, path, hash, size, device)."""
    full = [(k, f"i{k}", None, None, s, p, path, h, n, "text/plain", "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00+00:00", None, d) for k, (s, p, path, h, n, d) in enumerate(rows)]
    return spark.createDataFrame(full, schemas.FILE_INSTANCE)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture
def copies(spark):
    return instances(spark, [("s1", "server", "/docs/a.pdf", "hash1", 100, None), ("g1", "gdrive", "/d/a.pdf", "hash1", 100, None), ("d1", "dropbox", "/a.pdf", "hash1", 100, None), ("o1", "onedrive", "/o.pdf", "hash2", 100, None)])


def test_duplicates(spark, copies):
    assert duplicates.duplicates_for_hash(copies, "hash1").count() == 3
    assert duplicates.duplicates_for_hash(copies, "hash1", size=1).count() == 0
    g = duplicates.with_member_arrays(copies).collect()
    assert len(g) == 1 and g[0].instance_ids == ["i0", "i1", "i2"] and g[0].providers == ["server", "gdrive", "dropbox"]
    canonical, all_rows = duplicates.unify(copies, "canon-1")
    assert canonical.first().content_hash == "hash1" and {r.canonical_id for r in all_rows.collect()} == {"canon-1"}
    with pytest.raises(Exception, match="empty"):
        duplicates.unify(copies.limit(0), "c")[0].collect()
    deleted = copies.withColumn("deleted_at", F.when(F.col("ord") < 2, "x"))
    assert duplicates.duplicate_groups(deleted).collect() == []
    text = [r.line for r in reporting.duplicate_report(duplicates.duplicate_groups(copies)).orderBy("line_no").collect()]
    assert text[2] == "1. hash=hash1 size=100 mime=text/plain instances=3 providers=['dropbox', 'gdrive', 'server']"
    assert [r.line for r in reporting.duplicate_report(duplicates.duplicate_groups(copies.limit(0))).collect()] == ["No duplicate groups detected."]


def test_moves_and_copies(spark):
    previous = instances(spark, [("1", "server", "/a.txt", "h1", 10, "d1"), ("2", "server", "/b.txt", "h2", 10, "d1")])
    current = instances(spark, [("1", "server", "/archive/a.txt", "h1", 10, "d1"), ("2", "server", "/b.txt", "h2", 10, "d1"), ("3", "dropbox", "/shared/b.txt", "h2", 10, "d2")])
    events = moves.detect(previous, current)
    found = {r.event_type: r for r in events.collect()}
    assert set(found) == {"move", "copy"} and found["move"].to_path == "/archive/a.txt" and found["copy"].from_path == "/b.txt"
    assert {r.path for r in moves.apply_moves(previous, events).collect()} == {"/archive/a.txt", "/b.txt"}
    assert {r["from"] for r in moves.audit_log(events).collect()} == {"server:/a.txt", "server:/b.txt"}


def test_surplus_of_a_move_is_dropped_and_null_devices_are_equal(spark):
    previous = instances(spark, [("1", "p", "/a", "h", 1, None), ("2", "p", "/stays", "h", 1, None)])
    current = instances(spark, [("1", "p", "/x", "h", 1, None), ("2", "p", "/stays", "h", 1, None), ("3", "p", "/y", "h", 1, None)])
    found = moves.detect(previous, current).collect()
    assert [(r.event_type, r.from_path, r.to_path) for r in found] == [("move", "/a", "/x")]


def test_delta(spark):
    known = instances(spark, [("g1", "gdrive", "/a.txt", "h1", 10, None)])
    event = lambda k, kind, s, path, h, n: (k, "gdrive", kind, s, path, h, n, "text/plain" if h else None, "2026-01-02T00:00:00+00:00" if h else None, None, None)
    events = spark.createDataFrame([event(0, "modified", "g1", "/a.txt", "h2", 20), event(1, "new", "g2", "/b.txt", "h3", 30), event(2, "deleted", "g1", "/a.txt", None, None), event(3, "moved", "g3", "/c", None, None)], schemas.DELTA_EVENT)
    up = {r.source_id: r for r in delta.upserts(events, known).collect()}
    assert set(up) == {"g1", "g2"} and up["g1"].instance_id == "i0" and up["g1"].content_hash == "h2" and up["g2"].instance_id.startswith("n-")
    assert [r.instance_id for r in delta.deletions(events, known).collect()] == ["i0"]
    assert [r.source_id for r in delta.moves(events).collect()] == ["g3"]
    assert [one(spark, delta.strategy(F.lit(x))) for x in (None, "", "c")] == ["full", "full", "incremental"]


def test_reconcile(spark):
    provider = instances(spark, [("g1", "gdrive", "/a", "h1", 1, None), ("g2", "gdrive", "/b", "h2", 1, None)])
    ours = instances(spark, [("g1", "gdrive", "/a", "h9", 1, None), ("g3", "gdrive", "/c", "h3", 1, None), ("z", "other", "/z", "h", 1, None)])
    assert {r.source_id: r.drift for r in delta.reconcile("gdrive", provider, ours).collect()} == {"g1": "hash_mismatch", "g2": "missing_in_inventory", "g3": "missing_in_provider"}


def test_versions(spark):
    row = "struct<content_hash:string,size:long,path:string,provider:string,canonical_id:string>"
    a = ("hash1", 100, "/docs/a.txt", "server", "c")
    pairs = [(a, ("hash1", 100, "/archive/a.txt", "server", None)), (a, ("hash2", 120, "/docs/a.txt", "server", None)), (a, ("hash3", 250, "/new/b.txt", "gdrive", None)), (a, a)]
    got = versions.classify_pairs(spark.createDataFrame(pairs, f"old {row}, new {row}")).collect()
    assert [(r.change_type, r.canonical_id) for r in got] == [("same_version_new_location", "c"), ("new_version_same_path", "c"), ("new_canonical_object", None), ("unchanged", "c")]
    v = spark.createDataFrame([(k, f"v{k}", "c1", f"v{k - 1}" if k else None, "h", 1, "p", "/x", f"2026-01-{k + 1:02d}") for k in range(20)], schemas.FILE_VERSION)
    assert {r.version_id: r.depth for r in versions.depths(v).collect()} == {f"v{k}": k for k in range(20)}
    h = versions.history_of(v, "c1").first()
    assert h.version_count == 20 and h.lineage[0].version_id == "v0"
    lineage = "struct<version_id:string,canonical_id:string>"
    good = spark.createDataFrame([(("a", "c"), ("b", "c"))], f"old {lineage}, new {lineage}")
    assert versions.link_pairs(good, F.lit("c")).first().parent_version_id == "a"
    with pytest.raises(Exception, match="another lineage"):
        versions.link_pairs(good, F.lit("d")).collect()
    loop = v.limit(2).withColumn("parent_version_id", F.when(F.col("ord") == 0, "v1").otherwise("v0"))
    with pytest.raises(ValueError, match="cycle"):
        versions.depths(loop, rounds=6).collect()


def test_reporting(spark):
    t = one(spark, reporting.throughput(F.lit(10485760.0), F.lit(50.0), F.lit(2.0)))
    assert (t.files_per_second, t.mb_per_second) == (25.0, 5.0)
    assert one(spark, reporting.throughput(F.lit(1.0), F.lit(1.0), F.lit(0.0))).files_per_second == 0.0
    s = spark.createDataFrame([("b", "full", None, None, "x", 1), ("a", "full", None, None, None, 0)], schemas.SYNC_STATE)
    rows = reporting.sync_dashboard(s).collect()
    assert [(r.provider_id, r.healthy, r.provider_count, r.healthy_count) for r in rows] == [("a", True, 2, 1), ("b", False, 2, 1)]


def test_chain_of_a_long_session(spark):
    """A session over many batches is chained as one, and no task holds it whole."""
    rows = [(s, k, f"t{k}", f"c{k % 7}", f"{s}/{k}") for s, n in (("long", 1000), ("one", 1), (None, 30), ("two", 40)) for k in range(n)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        df = spark.createDataFrame(rows, "session_id string, seq long, timestamp_uuid7 string, content_hash string, frame_id string").repartition(7)
        built = chain.build(df)
        found = {(r.session_id, r.seq): (r.previous_event_hash, r.event_hash) for r in built.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, last = {}, {}
    for s, k, t, c, f in rows:
        body = json.dumps({"blake3_hash": c, "frame_id": f, "previous_event_hash": last.get(s), "timestamp_uuid7": t}, separators=(",", ":"))
        h = hashlib.sha256(body.encode()).hexdigest()
        want[s, k], last[s] = (last.get(s), h), h
    assert found == want
    assert "FlatMapGroups" not in built._jdf.queryExecution().executedPlan().toString()


def test_chain(spark):
    rows = [("s", k, f"t{k}", f"h{k}", f"frame-{k}") for k in range(3)] + [("u", 0, "t", "h", "f")]
    built = chain.build(spark.createDataFrame(rows, "session_id string, seq long, timestamp_uuid7 string, content_hash string, frame_id string"))
    ok = {r.session_id: (r.n, r.chain_valid, r.valid_prefix) for r in chain.verify(built).collect()}
    assert ok == {"s": (3, True, 3), "u": (1, True, 1)}
    bad = built.withColumn("event_hash", F.when(F.col("seq") == 1, "0" * 64).otherwise(F.col("event_hash")))
    assert {r.session_id: (r.chain_valid, r.valid_prefix) for r in chain.verify(bad).collect()}["s"] == (False, 1)
    link = built.withColumn("previous_event_hash", F.lit("edited"))
    assert all(r.chain_valid for r in chain.verify(link).collect()) and not any(r.chain_valid for r in chain.verify(link, strict=True).collect())
    frames = spark.createDataFrame([("s", "dev", k, bytearray(b"frame"), "image/png", 1000 + k) for k in range(2)], "session_id string, device_id string, seq long, payload binary, mime_type string, captured_ms long")
    made = chain.frame_tables(frames)
    assert {k: v.count() for k, v in made.items()} == dict.fromkeys(("canonical", "version", "instance", "frame", "event"), 2)
    assert all(r.chain_valid for r in chain.bundle(chain.sessions(made["event"]), made["frame"], made["event"]).collect())


def test_ingest(spark):
    good = ("u1", "/a.txt", "h1", "code", "text/plain")
    df = spark.createDataFrame([good, ("u2", "/b", "h2", "user", "x/y"), good, (None, "/only-path", None, None, None)], "uuid7 string, path string, blake3 string, category string, mime_type string")
    assert (ingest.nodes(df).count(), ingest.edges(df).count(), ingest.embeddings(df).count(), ingest.sync_embeddings(df).count()) == (2, 2, 2, 4)
    assert [(r.record, r.error) for r in ingest.errors(df).collect()] == [("unknown", "record missing keys: blake3, category, mime_type, uuid7")]
    assert tuple(ingest.dry_run(df).first()) == (True, 2, 1)
    v = one(spark, ids.embed_text(F.lit("/a.txt")))
    assert v == [round(b / 255.0, 6) for b in hashlib.sha256(b"/a.txt").digest()[:16]]


def test_merge_and_snapshots(spark, tmp_path):
    target = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "id string, v int, created_at string")
    source = spark.createDataFrame([("a", 5, "new", 0), ("a", 6, "new", 1), ("c", 7, "new", 0)], "id string, v int, created_at string, ord long")
    got = sorted(tuple(r) for r in merge.merge(target, source, ["id"], untouched=("created_at",)).collect())
    assert got == [("a", 6, "old"), ("b", 2, "old"), ("c", 7, "new")]
    t = merge.Snapshots(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.write(target)
    t.merge(source, ["id"])
    assert t.read().count() == 3


def brute_score(a, b):
    cos = float(np.dot(a[2], b[2]) / (np.linalg.norm(a[2]) * np.linalg.norm(b[2]))) if np.any(a[2]) and np.any(b[2]) else 0.0
    return 0.7 * cos + 0.3 * (1 - sum((int(x, 16) ^ int(y, 16)).bit_count() for x, y in zip(a[1], b[1], strict=True)) / 192)


@pytest.fixture
def prints(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(k, [f"{int(x):016x}" for x in rng.integers(0, 2**62, 3)], (base[k % 6] + 0.2 * rng.normal(size=8)).tolist()) for k in range(30)]
    df = spark.createDataFrame([(k, f"f{k:02d}", f"c{k // 2:02d}", *h, e) for k, h, e in rows], schemas.FINGERPRINT)
    return rows, df


def test_similarity(spark, prints):
    rows, df = prints
    want = {(a[0], b[0]): brute_score(a, b) for a in rows for b in rows if a[0] < b[0]}
    for block in (1024, 4):
        got = {(r.a_ord, r.b_ord): r.score for r in similarity.pairs(df, 0.75, block).collect()}
        assert got.keys() == {k for k, s in want.items() if s >= 0.75} and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    best = [(r.file_id, r.score) for r in similarity.similar_to(df, "f03", 0.5, 4).collect()]
    mine = sorted(((round(want[min(3, k), max(3, k)], 6), -k) for k in range(30) if k != 3), reverse=True)
    assert best == [(f"f{-k:02d}", s) for s, k in mine if s >= 0.5][:4]
    assert similarity.similar_to(df, "none").collect() == []
    every = similarity.clusters(df, 0.8).collect()
    assert [r.n for r in every] == sorted((r.n for r in every), reverse=True)
    for r in every:
        assert abs(math.fsum(x * x for x in r.embedding) - 1) < 1e-9 and r.members == sorted(set(r.members))


def test_cluster_new_file(spark, prints):
    _, df = prints
    store = similarity.SimilarityStore(df, 0.75)
    created = store.add_to_clusters("f00")
    members = {r.canonical_file_id for r in created.collect()}
    expect = {r.canonical_file_id for r in store.similar("f00").collect()} | {"c00"}
    assert members == (expect if len(expect) > 1 else set())
    again = {r.canonical_file_id for r in store.add_to_clusters("f00").collect()}
    assert again == members and {r.canonical_file_id for r in store.members.collect()} == members
    store.upsert(df.where("file_id = 'f05'"))
    assert store.fingerprints.count() == 30 and store.fingerprints.orderBy(F.desc("ord")).first().file_id == "f05"
    assert store.rebuild().count() >= len(members)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(40)]
    low = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == low
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_perceptual(spark):
    image = [[(20 + 7 * x + 13 * y) % 256 for x in range(16)] for y in range(16)]
    m = F.from_json(F.lit(str(image)), "array<array<int>>")
    sized = lambda h, w: [[image[min(int(y / h * 16), 15)][min(int(x / w * 16), 15)] for x in range(w)] for y in range(h)]
    flat = [v for r in sized(8, 8) for v in r]
    hexed = lambda bits: f"{int(''.join(map(str, bits)), 2):016x}"
    assert one(spark, perceptual.ahash(m)) == hexed([int(v >= sum(flat) / 64) for v in flat])
    assert one(spark, perceptual.dhash(m)) == hexed([int(r[x] >= r[x + 1]) for r in sized(8, 9) for x in range(8)])
    n = 32
    big = np.array(sized(n, n), float)
    table = np.array([[math.sqrt((1 if k == 0 else 2) / n) * math.cos((2 * i + 1) * k * math.pi / (2 * n)) for i in range(n)] for k in range(n)])
    freq = (table @ big @ table.T)[:8, :8].ravel()
    near = np.abs(np.sort(freq[1:]) - sorted(freq[1:])[31])
    got = one(spark, perceptual.phash(m))
    assert len(got) == 16
    clear = [k for k in range(64) if abs(freq[k] - sorted(freq[1:])[31]) > 1e-6]
    bits = f"{int(got, 16):064b}"
    assert all(bits[k] == str(int(freq[k] >= sorted(freq[1:])[31])) for k in clear) and len(clear) > 30 and near.min() == 0
    assert one(spark, vectors.hamming(F.lit("ff00000000000001"), F.lit("0f00000000000000"))) == 5
    with pytest.raises(Exception, match="lengths must match"):
        one(spark, vectors.hamming(F.lit("ff"), F.lit("f")))
    with pytest.raises(Exception, match="non-empty"):
        one(spark, perceptual.ahash(F.from_json(F.lit("[]"), "array<array<int>>")))


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, a)) == 1.0 and one(spark, vectors.cosine(a, b)) == 0.0
    with pytest.raises(Exception, match="dimensions must match"):
        one(spark, vectors.cosine(a, F.array(F.lit(1.0))))
    body = bytes(range(256)) + b"zzz"
    h = np.bincount([x * 32 // 256 for x in body], minlength=32)
    assert np.allclose(one(spark, vectors.byte_histogram(F.unhex(F.lit(body.hex())), 32)), h / np.linalg.norm(h))
    assert one(spark, vectors.byte_histogram(F.lit(b""), 4)) == [0.0] * 4


def test_paths(spark):
    p = lambda f, *v: one(spark, f(*map(F.lit, v)))
    assert p(paths.windows_to_wsl, "C:\\Users\\ann\\docs") == "/mnt/c/Users/ann/docs"
    assert p(paths.wsl_to_windows, "/mnt/c/Users/ann/docs") == "C:\\Users\\ann\\docs"
    assert p(paths.wsl_to_windows, "/mnt/c") == "C:\\" and p(paths.wsl_to_windows, "/home/x") == "/home/x"
    assert [p(paths.is_wsl, x) for x in ("/mnt/c", "/mnt", "/a/mnt/c")] == [True, False, False]
    assert p(paths.extended_length, "C:\\x") == "\\\\?\\C:\\x" and p(paths.extended_length, "\\\\host\\s") == "\\\\?\\UNC\\host\\s" and p(paths.extended_length, "/x") == "/x"
    assert [p(paths.suffix, x) for x in ("a.tar.GZ", ".hidden", "x.", "dir.d/file", "a.b\nc.txt")] == [".gz", "", "", "", ".txt"]
    assert [p(paths.provider_hint, x) for x in ("/media/Google Drive", "/mnt/phone", "/mnt/Dropbox", "/mnt/x")] == ["gdrive", "onedrive", "dropbox", None]
    assert [p(paths.source_type, a, b) for a, b in (("GDrive", "/x"), ("local", "\\\\h\\s"), ("local", "/mnt/x"), ("ssh", "/x"), ("other", "/x"))] == ["gdrive", "network", "external", "local", "provider"]
    assert [p(paths.detected_provider, x) for x in ("/home/Dropbox", "x.gdoc", "C:\\x", "/mnt/c/x", "/home")] == ["dropbox", "gdrive", "windows", "wsl", None]
    assert p(paths.pair_key, "b", "a") == "a|b" and p(paths.z_path_id, "z:// abc ") == "abc" and p(paths.z_path_id, "z://") is None
    assert one(spark, paths.under_prefix(F.lit("/procx"), ["/proc"])) is False and one(spark, paths.under_prefix(F.lit("/proc/1"), ["/proc"])) is True
    assert one(spark, paths.canonical_path("/store", F.lit("ab"))) == "/store/sha256/ab"
    assert one(spark, paths.log_completion(F.lit("INFO Stage 2 complete"))) == 2
    assert one(spark, paths.short_name(F.lit("abcdefghij"), 5)) == "…ghij"


def test_classify(spark):
    def kind(path):
        m = classify.mime_type(F.lit(path))
        c = classify.category(F.lit(path), m)
        return tuple(one(spark, F.struct(c, classify.shortcut_allowed(c))))

    assert kind("/x/example.py") == ("code", True) and kind("/x/a.txt") == ("code", True) and kind("/x/.env") == ("system", False)
    assert kind("/x/windows/a.py") == ("system", False) and kind("/x/pic.JPG") == ("media", True) and kind("/x/blob") == ("binary", False) and kind("/x/a.pdf") == ("user", True)
    assert kind("/x/Thumbs.db") == ("system", False) and kind("~$doc.docx") == ("system", False)
    assert one(spark, classify.mime_type(F.lit("notes.gdoc"), pointers=True)) == "application/vnd.google-apps.document"


def test_digests_and_ids(spark):
    assert one(spark, digests.digest(F.lit("abc"), "blake2b")) == hashlib.blake2b(b"abc", digest_size=32).hexdigest()
    both = one(spark, digests.dual_digest(F.lit("abc")))
    assert both.algorithm == "blake2b" and both.sha256 == hashlib.sha256(b"abc").hexdigest()
    assert one(spark, digests.quick_hash(F.lit("/a"), F.lit(1), F.lit(2.5))) == hashlib.blake2b(b"/a12.5", digest_size=16).hexdigest()
    assert one(spark, digests.canonical_json(b=F.lit(None).cast("string"), a=F.lit(1))) == '{"a":1,"b":null}'
    with pytest.raises(ValueError):
        digests.digest(F.lit("x"), "md4")
    made = [r.x for r in spark.range(200).select(ids.uuid7().alias("x")).collect()]
    assert len(set(made)) == 200 and all(len(x) == 36 and x[14] == "7" for x in made)
    assert one(spark, ids.id_millis(ids.id_at(F.lit(1700000000123), F.lit("k")))) == 1700000000123


def test_times(spark):
    assert one(spark, F.unix_millis(times.iso_time(F.lit("2026-01-01T00:00:01Z")))) == 1767225601000 and one(spark, times.iso_time(F.lit("no"))) is None
    assert one(spark, times.progress(F.lit(1), F.lit(0))) == 100.0 and one(spark, times.progress(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, times.clock(F.lit(3723.9))) == "1:02:03" and one(spark, times.clock(F.lit(-1.0))) == "–"
    assert one(spark, times.bytes_text(F.lit(1536))) == "1.5 KB" and one(spark, times.bytes_text(F.lit(12))) == "12 B"


def test_lookup(spark):
    files = spark.createDataFrame([("u1", "h1", "/a"), ("u2", "h2", "/b")], "uuid7 string, blake3 string, path string")
    got = lookup.resolve_z_paths(spark.createDataFrame([("z://u1",), ("z://",), ("z://nope",), ("/x",)], "z_path string"), files).collect()
    assert {r.z_path: (r.path, r.error is None) for r in got} == {"z://u1": ("/a", True), "z://": (None, False), "z://nope": (None, False), "/x": (None, False)}
    wanted = spark.createDataFrame([("u1", None, "/b"), (None, "h2", None), (None, None, "/a"), (None, None, None)], "uuid7 string, hash string, path string")
    assert [(r.found_uuid7, r.error is None) for r in lookup.find_any(wanted, files).orderBy(F.desc("uuid7"), F.desc("hash"), F.desc("path")).collect()] == [("u1", True), ("u2", True), ("u1", True), (None, False)]
    names = lookup.resolve_aliases(spark.createDataFrame([("ANN",), ("x",)], "name string"), spark.createDataFrame([("e1", ["Ann", "a"])], "entity_id string, aliases array<string>"))
    assert {r.name: r.entity_id for r in names.collect()} == {"ANN": "e1", "x": None}
    m = lambda *x: spark.createDataFrame([(v,) for v in x], "mount_path string")
    assert [tuple(r) for r in lookup.new_mounts(m("/mnt/a"), m("/mnt/a", "/media/Google Drive")).collect()] == [("linux", "/media/Google Drive", "gdrive")]
    assert [r.mount_path for r in lookup.new_mounts(m("C:\\"), m("C:\\", "E:\\"), "windows").collect()] == ["E:\\"]
    assert [r.provider_hint for r in lookup.new_mounts(m(), m("/mnt/d", "/x"), "wsl").collect()] == ["wsl"]


def test_rules(spark):
    assert one(spark, lookup.autonomy_score(F.lit("warp"), F.lit("execution"))) == 3 and one(spark, lookup.autonomy_score(F.lit("?"), F.lit("compute"))) == 3
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert "Warp" in one(spark, lookup.lane_gate(F.lit("cody"), yes, none, yes)) and "not authorized" in one(spark, lookup.lane_gate(F.lit("warp"), yes, none, no)) and "passed" in one(spark, lookup.lane_gate(F.lit("x"), no, no, none))
    assert tuple(one(spark, lookup.route(F.lit("Deploy")))) == ("warp", 0.95) and one(spark, lookup.escalation_target(F.lit("?"))) == "operator"
    assert tuple(one(spark, lookup.permissions(F.lit("ingest")))) == (True, True, False) and tuple(one(spark, lookup.permissions(F.lit("canonicalize")))) == (True, True, True)
    w = spark.createDataFrame([("w1", "warp", 1.0, 0), ("w2", "warp", 2.0, 1), ("w3", "warp", 2.0, 2)], "worker_id string, lane string, score double, ord long")
    assert {r.job_id: r.worker_id for r in lookup.best_worker(spark.createDataFrame([("j", "warp"), ("k", "x")], "job_id string, lane_hint string"), w).collect()} == {"j": "w2", "k": None}


def test_status(spark):
    state = spark.createDataFrame([(0, 100, 40, 0, 100, 80, True, False, None, None, "2026-01-01T00:00:00Z", None)], status.STATE)
    now = F.to_timestamp(F.lit("2026-01-01T00:01:00Z"))
    r = status.live_status(state, sample_there=True, index_there=False, now=now).first()
    assert (r.current_stage, r.stage_elapsed_seconds, r.pipeline_active, r.crawl_progress, r.filesystem_count) == (2, 60.0, True, "available", 80)
    idle = status.live_status(state.limit(0), sample_there=False, index_there=False).first()
    assert (idle.current_stage, idle.pipeline_active, idle.crawl_phase, idle.stage_description) == (1, False, True, "Crawling filesystem…")
    records = spark.createDataFrame([("u", "/a", "s", 1, "h", "Canonical", True), ("v", "/b", "s", 1, "h", "code", None)], "uuid7 string, path string, source string, size long, blake3 string, category string, shortcut_allowed boolean")
    got = status.pipeline_status(state, records, records.limit(1)).first()
    assert (got.filesystem_count, got.canonical_count, got.shortcut_count, got.scanner_progress, got.processed_progress) == (80, 1, 1, 50.0, 2.5)
    v = {r.check: r.passed for r in status.verification(state, records, records).collect()}
    assert len(v) == 8 and v["stage1_complete"] and not v["stage2_complete"] and v["manifest_record_keys"]
    log = spark.createDataFrame([(k, f"e{k}") for k in range(150)], "ord long, error string")
    assert [r.ord for r in status.run_errors(log).collect()] == list(range(50, 150))


def test_chat(spark):
    rows = [("m1", "p", "w", "c", "1", "a", "user", "hello  big\nworld", "2026-01-01", "2026-01-01"), ("m2", "p", "w", "c", "1", "a", "user", "hello again", "2026-01-01", "2026-01-02"), ("m3", "p", None, "c", "2", "a", "user", None, "2026-01-01", "2026-01-02")]
    df = spark.createDataFrame(rows, schemas.MESSAGE.replace("timestamp", "string"))
    df = df.withColumn("created_at", F.to_timestamp("created_at")).withColumn("ingested_at", F.to_timestamp("ingested_at"))
    assert {r.message_id for r in chat.distinct_messages(df).collect()} == {"m2", "m3"}
    assert chat.normalized(df).where("message_id = 'm1'").first().body_text == "hello big world"
    found = chat.search(df, ["hello", "big"]).collect()
    assert [(r.message_id, r.score) for r in found] == [("m1", 0.4), ("m2", 0.2)]
    assert one(spark, chat.ranking(F.lit(1.0), F.lit(0.5), F.lit(0.0))) == pytest.approx(0.6)


def test_progress(spark):
    rows = spark.createDataFrame([("k", n, float(n + 1)) for n in range(4)], "key string, n int, s double")
    got = reporting.progress_snapshots(rows, "key", F.lit(8), ["n"], F.col("s")).orderBy("n").collect()
    assert [(r.done, r.files_per_second, r.eta_seconds) for r in got] == [(k + 1, 1.0, 7.0 - k) for k in range(4)]


def test_source_ids(spark):
    a = one(spark, digests.source_id(F.lit("local"), F.lit("/r"), F.lit("dev"), F.lit(None).cast("string")))
    assert a == hashlib.sha256(b'{"device_uuid":"dev","label":null,"provider":"local","root":"/r"}').hexdigest()
    assert one(spark, digests.cloud_root_id(F.lit("gdrive"), F.lit("/r"))) == hashlib.sha256(b'{"kind":"cloud-root","provider":"gdrive","root":"/r"}').hexdigest()
    fallback = one(spark, digests.metadata_digest(path=F.lit("/a"), size=F.lit(3)))
    assert fallback.algorithm == "fallback" and fallback.digest == hashlib.sha256(b'{"path":"/a","size":3}').hexdigest()


def test_references(spark):
    child = spark.createDataFrame([("a",), ("b",), (None,)], "file_id string")
    parent = spark.createDataFrame([("a",)], "id string")
    assert [r.file_id for r in ingest.violations(child, "file_id", parent, "id").collect()] == ["b"]
    assert ingest.batch_row(spark, "b", "s", "now").first().status == "pending"
    rows = spark.createDataFrame([(0, "u", "/a", "s", 1, 2.0, 3, "sha256", "h", "code", "t", True, "x"), (1, "u", "/b", "s", 5, 2.0, 3, "sha256", "h", "code", "t", True, "")], "ord long, uuid7 string, path string, source string, size long, mtime double, mode int, hash_algorithm string, blake3 string, category string, mime_type string, shortcut_allowed boolean, sha256 string")
    made = ingest.table_rows(rows, "b1", spark.createDataFrame([("u", 4)], "file_id string, version_number int"))
    assert [r.version_number for r in made["versions"].orderBy("version_number").collect()] == [5, 6] and made["hashes"].count() == 3
    files = ingest.upsert_files(made["files"].drop("ord").limit(0), made["files"])
    assert [(r.id, r.path) for r in files.collect()] == [("u", "/b")]
    hashes = ingest.upsert_hashes(made["hashes"].drop("ord").limit(0), made["hashes"])
    assert sorted((r.algorithm, r.digest, r["size"]) for r in hashes.collect()) == [("sha256", "h", 5), ("sha256", "x", 1)]


def test_hot_digests_are_numbered_by_ranges(spark):
    """The same events whether a digest's rows are numbered by one task or by ranges."""
    columns = "ord long, instance_id string, canonical_id string, provider string, path string, device_id string, content_hash string"
    before = [(i, f"i{i}", None, "p", f"/old/{i}" if i % 3 else f"/same/{i}", "d" if i % 2 else None, "empty" if i % 5 else f"h{i}") for i in range(120)]
    after = [(i, f"i{i}", None, "p", f"/new/{i * 7 % 120}" if i % 3 else f"/same/{i}", "d" if i % 2 else None, "empty" if i % 5 else f"h{i}") for i in range(130)]
    old, new = spark.createDataFrame(before, columns), spark.createDataFrame(after, columns)
    want = sorted(map(str, moves.detect(old, new).collect()))
    assert sorted(map(str, moves.detect(old, new, hot_rows=10).collect())) == want and len(want) >= 80


def test_first_path_of_a_digest_is_copied(spark):
    from tallyframe.operators import canonical

    files = spark.createDataFrame([("/b", "x"), ("/a", "x"), ("/c", "y"), ("/d", None)], "path string, digest string")
    assert {(r.path, r.copied) for r in canonical.plan(files, "/s").collect()} == {("/a", True), ("/b", False), ("/c", True), ("/d", True)}
