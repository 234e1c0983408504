"""Directory trees, manifests, stores behind commands and the canonical store, in temporary folders."""

import hashlib
import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import canonical
from tallyframe.operators.merge import Snapshots
from tallyframe.sources import manifests, providers, walk
from tallyframe.streaming import stages


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    files = {"sample.txt": b"hello", ".hidden": b"h", "_name": b"u", "noext": b"\x00", "a.tar.gz": b"g", "dot.": b"d", "sub/example.py": b"print()", "sub/deep/notes.gdoc": b'{"id": 1}', "sub/new\nline.md": b"m", "Temp/skip.txt": b"s", "docker/skip.txt": b"s", "archive/old.url": b"hello", "keep.dropbox": b"x"}
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    os.symlink(root / "sample.txt", root / "link.txt")
    os.symlink(root / "nowhere", root / "broken")
    return root, files


def test_walk(spark, tree):
    root, files = tree
    got = {os.path.relpath(r.path, root): r for r in walk.walk(spark, str(root), digest="sha256").collect()}
    assert set(got) == {n for n in files if not n.startswith(("Temp", "docker"))} | {"link.txt"}
    for name, r in got.items():
        body = files.get(name, b"hello")
        assert r.sha256 == r.digest == hashlib.sha256(body).hexdigest() and r.size == len(body) and stat.S_ISREG(r.mode)
    assert got["link.txt"].is_symlink and walk.walk(spark, str(root), (), digest="blake2b").where("name = 'skip.txt'").count() == 1
    assert walk.walk(spark, str(root), excluded_prefixes=(str(root / "sub"),)).where(F.col("path").contains("/sub/")).count() == 0
    assert walk.walk(spark, str(root), errors=True).where("error is not null").select("name").first().name == "broken"
    assert walk.count_files(spark, [str(root), "/no/such/root"]) == len(got)
    with pytest.raises(Exception, match="no/such"):
        walk.walk(spark, "/no/such").collect()
    done = spark.createDataFrame([(str(root / "sample.txt"), os.stat(root / "sample.txt").st_mtime), (str(root / "_name"), 1.0)], "path string, mtime double")
    assert walk.changed(walk.walk(spark, str(root)), done).count() == len(got) - 1


def test_providers(spark, tree):
    root, _ = tree
    local = {os.path.basename(r.path): r for r in providers.scan(spark, str(root)).collect()}
    lost = local.pop("broken")
    assert json.loads(lost.metadata)["stat_error"] and lost.hash_algorithm == "fallback" and len(lost.blake3) == 64
    assert local["example.py"].category == "code" and local["example.py"].shortcut_allowed and local[".hidden"].category == "system" and local["noext"].category == "binary"
    assert len({r.uuid7 for r in local.values()}) == len(local) and {r.source_type for r in local.values()} == {"local"}
    drive = {os.path.basename(r.path): r for r in providers.scan_gdrive(spark, str(root)).collect()}
    assert drive["notes.gdoc"].mime_type == "application/vnd.google-apps.document" and json.loads(json.loads(drive["notes.gdoc"].metadata)["descriptor"]) == {"id": 1}
    assert drive["sample.txt"].source_type == "gdrive" and "skip.txt" in drive
    meta = lambda rows: {os.path.basename(r.path): json.loads(r.metadata) for r in rows.collect()}
    one = meta(providers.scan_onedrive(spark, str(root)))
    assert one["old.url"]["placeholder"] and one["old.url"]["selective_sync"] and not one["sample.txt"]["placeholder"]
    assert meta(providers.scan_dropbox(spark, str(root)))["keep.dropbox"] ["online_only"]
    assert meta(providers.scan_windows(spark, str(root)))[".hidden"]["hidden"]
    assert meta(providers.scan_wsl(spark, str(root)))["sample.txt"]["windows_path"].endswith("sample.txt")
    with pytest.raises(KeyError):
        providers.scanner("nothing")
    with pytest.raises(FileNotFoundError):
        providers.scan(spark, "/no/such/path")
    providers.register("mine", lambda s, t: s.range(3))
    assert "mine" in providers.providers() and providers.scan(spark, "mine").count() == 3
    del providers._SCANNERS["mine"]
    wsl = providers.provider("wsl")
    assert wsl.detect(spark, "/mnt/c/x") and not wsl.detect(spark, "/home") and wsl.metadata()["capabilities"] == ("scan",) and wsl.default_target() in (None, "/mnt/c")


def test_walk_splits_deep_trees_and_tells_errors(spark, tmp_path):
    at = tmp_path / "one"
    for k in range(8):
        (at / "only" / f"d{k}" / "e").mkdir(parents=True)
        (at / "only" / f"d{k}" / "e" / "f.txt").write_text("x")
    reader = walk.WalkReader({"root": str(at)})
    assert len([p for p in reader.partitions() if p.deep]) == 0 and len(reader.partitions()) == 18  # each folder on its own
    assert walk.walk(spark, str(at)).count() == 8 == walk.count_files(spark, [str(at), str(at / "only"), str(at)])
    part = walk._Part(str(at / "gone"), True)
    assert list(walk.WalkReader({"root": str(at), "errors": "true"}).read(part))[0][1] == "gone" and not list(reader.read(part))
    assert stages.prefixes_for("/") == stages.SYSTEM_PREFIXES and "/tmp" not in stages.prefixes_for("/tmp/x") and "/usr" in stages.prefixes_for("/tmp/x")


def script(path, body):
    path.write_text("#!/bin/sh\n" + body)
    path.chmod(0o755)
    return str(path)


def test_ssh_and_rclone(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    (store / "a b.txt").write_bytes(b"remote")
    ssh = script(tmp_path / "ssh", 'for last; do :; done\nexec sh -c "$last"\n')
    r = providers.scan_ssh(spark, "host", str(store), program=ssh).collect()
    assert len(r) == 1 and r[0].sha256 == hashlib.sha256(b"remote").hexdigest() and r[0].source == f"ssh://host{store}" and 0 < r[0].mode <= 0o777
    listing = json.dumps([{"Path": "a b.txt", "Size": 6, "IsDir": False}, {"Path": "d", "IsDir": True}])
    inner = json.dumps([{"Path": "e/c.txt", "Size": 6}, {"Path": "e", "IsDir": True}]).replace("}, {", "},\n{")
    rclone = script(tmp_path / "rclone", f"if [ \"$1\" = lsjson ]; then case \"$2\" in *:x) echo '{listing}';; *) echo '{inner}';; esac; else cat '{store}/a b.txt'; fi\n")
    r = sorted(providers.scan_rclone(spark, "remote", "x", program=rclone).collect(), key=lambda x: x.path)
    assert [(x.path, x.size, x.mtime, x.mode, x.blake3) for x in r] == [(p, 6, 0.0, 0, hashlib.sha256(b"remote").hexdigest()) for p in ("a b.txt", "d/e/c.txt")]
    (store / "in" / "deep").mkdir(parents=True)
    (store / "in" / "deep" / "b.txt").write_bytes(b"remote")
    assert sorted(os.path.basename(x.path) for x in providers.scan_ssh(spark, "host", str(store), program=ssh).collect()) == ["a b.txt", "b.txt"]
    with pytest.raises(Exception, match="returned non-zero"):
        providers.scan_ssh(spark, "host", "/no/such", program=script(tmp_path / "bad", "exit 3\n")).collect()


def test_manifests(spark, tmp_path, tree):
    root, _ = tree
    records = providers.scan_local(spark, str(root)).drop("metadata")
    manifests.write_records(records.limit(3), str(tmp_path / "r"))
    manifests.write_records(records.limit(2), str(tmp_path / "r"))
    (tmp_path / "r" / "extra.json").write_text('\n{"path": broken\n{"path": "/only"}\n')
    assert manifests.read_records(spark, str(tmp_path / "r")).count() == 5
    manifests.write_manifest(spark, records, str(tmp_path / "m"), "src", source_id="x")
    header, rows = manifests.read_manifest(spark, str(tmp_path / "m"))
    assert header.first().source == "src" and header.first().generated_at and rows.count() == records.count()
    (tmp_path / "bad.json").write_text('{"source": "s"}')
    with pytest.raises(Exception, match="must be a list"):
        manifests.read_manifest(spark, str(tmp_path / "bad.json"))[1].collect()
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [r.a for r in manifests.read_array(spark, str(tmp_path / "list.json"), "a int").orderBy("ord").collect()] == [1, 2]
    (tmp_path / "log.txt").write_text("one\n two \n\n")
    assert manifests.last_line(spark, str(tmp_path / "log.txt")) == "two"
    (tmp_path / "done.json").write_text('{"path": "/a", "mtime": 1}\n{"path": "/a", "mtime": 2}\n{"path": "/b"}\nno\n')
    assert [tuple(r) for r in manifests.read_completed(spark, str(tmp_path / "done.json")).collect()] == [("/a", 2.0)]
    state = lambda: manifests.control_row(spark, str(tmp_path / "c"), '{"enabled": false}', "enabled boolean").first().enabled
    assert state() is False
    manifests.set_control(spark, str(tmp_path / "c"), {"enabled": True}, "enabled boolean")
    assert state() is True


def test_canonical_store(spark, tmp_path, tree):
    root, _ = tree
    files = walk.walk(spark, str(root), digest="sha256").select("path", F.col("sha256").alias("digest"))
    wrong = spark.createDataFrame([(str(root / "noext"), "0" * 64)], "path string, digest string")
    planned = canonical.plan(files.unionByName(wrong), str(tmp_path / "store"))
    for _ in range(2):
        status = {(r.path, r.canonical_path): r.status for r in canonical.materialize(planned, shortcuts=True).collect()}
    assert [k[0] for k, s in status.items() if s != "ok"] == [str(root / "noext")]
    for (path, at), s in status.items():
        if s == "ok":
            assert open(at, "rb").read() == open(path, "rb").read() and os.readlink(path + ".link") == at
    assert not [n for n in os.listdir(tmp_path / "store" / "sha256") if len(n) != 64]


def test_stages_resume(spark, tmp_path, tree):
    root, _ = tree
    first = stages.run(spark, str(root), str(tmp_path / "run"))
    n = first.count()
    assert first.where("error is not null").count() == 0 and Snapshots(spark, str(tmp_path / "run/sample")).read().count() == n
    (root / "more.txt").write_bytes(b"more")
    os.unlink(root / "_name")
    again = {os.path.basename(r.path): r for r in stages.run(spark, str(root), str(tmp_path / "run")).collect()}
    assert len(again) == n + 1 and again["more.txt"].digest == hashlib.sha256(b"more").hexdigest() and again["_name"].digest
    gone = Snapshots(spark, str(tmp_path / "gone"))
    lost = spark.createDataFrame([("/no/file", 1, 1.0)], "path string, size long, mtime double")
    assert stages.digest(lost, gone).first().error == "No such file or directory"


def test_providers_of_other_packages(spark, tmp_path, monkeypatch):
    import importlib.metadata
    import sys

    (tmp_path / "more_stores" / "inner").mkdir(parents=True)
    (tmp_path / "more_stores" / "__init__.py").write_text("")
    (tmp_path / "more_stores" / "tape.py").write_text(
        "from tallyframe.sources.providers import Provider, scan_local\n\n\nclass Tape(Provider):\n    name = 'tape'\n\n    def __init__(self):\n        super().__init__('tape', scan_local)\n\n\nshelf = Provider('shelf', scan_local)\nother = 5\n"
    )
    dist = tmp_path / "more_stores-1.dist-info"
    dist.mkdir()
    (dist / "METADATA").write_text("Name: more_stores\nVersion: 1\n")
    (dist / "entry_points.txt").write_text("[tallyframe.stores]\ntape = more_stores.tape:Tape\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.setattr(providers, "_SCANNERS", dict(providers._SCANNERS))
    assert sorted(providers.discover(("more_stores",))) == ["shelf", "tape"] and {"shelf", "tape", "gdrive"} <= set(providers.providers())
    assert providers.discover((), "tallyframe.stores") == ("tape",)
    assert providers.discover((), "no.such.group") == () and importlib.metadata.version("more_stores") == "1"
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.txt").write_text("x")
    assert providers.provider("tape").scan(spark, str(tmp_path / "data")).count() == 1
    sys.modules.pop("more_stores", None)


def test_migrations_stop_at_a_failure_and_go_on(spark, tmp_path):
    at = tmp_path / "sql"
    at.mkdir()
    (at / "a.sql").write_text("create or replace temporary view m_one as select 1 as x;\n")
    (at / "b.sql").write_text("create or replace temporary view m_two as select x + 1 as x from m_one;\nselect nonsense from nowhere;\n")
    with pytest.raises(Exception, match="nowhere"):
        manifests.migrate(spark, str(at), str(tmp_path / "done"))
    (at / "b.sql").write_text("create or replace temporary view m_two as select x + 1 as x from m_one where 'a;b' = 'a;b'")
    (at / "readme.txt").write_text("no statement")
    assert manifests.migrate(spark, str(at), str(tmp_path / "done")) == ["b.sql"] and spark.table("m_two").first().x == 2
    assert manifests.migrate(spark, str(at), str(tmp_path / "done")) == []
