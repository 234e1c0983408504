"""Registered queries over files and streams: tasks write a file for each document (and records, manifests and folders of events) to a new folder
below the shared one, and the sources under test read them. The folder has to be on a disk that driver and tasks share, as trees are."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from tallyframe.operators import canonical, delta, postings, status
from tallyframe.operators.graph import cut, numbered, shared_folder, small_batches
from tallyframe.operators.merge import Snapshots
from tallyframe.plans import views as W
from tallyframe.plans.queries import _CHAIN, query
from tallyframe.sources import feed, manifests, providers, ranges, walk
from tallyframe.streaming import chain as chain_stream
from tallyframe.streaming import delta as delta_stream
from tallyframe.streaming import recorder, stages, windows


def _folder(spark) -> str:
    at = shared_folder(spark).removeprefix("file:")
    if "://" in at:
        raise RuntimeError("trees of files need a folder on a local disk")
    return f"{at}/{uuid.uuid4().hex}"


def _tree(spark, d) -> str:
    """A file for each document, below its source's folder; every ninth is in one called Cache, which local scans leave out. Some have a link beside them that leads nowhere, some a pointer file."""
    root = f"{_folder(spark)}/tree"

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for k, source, text in zip(rows["doc_id"], rows["source"], rows["text"], strict=True):
                folder = f"{root}/{'Cache' if k % 9 == 4 else source or 'none'}"
                os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{k}.txt", "w", newline="") as f:
                    f.write(text or "")
                if k % 50 == 7 and not os.path.lexists(f"{folder}/{k}.lnk"):
                    os.symlink(f"{root}/nowhere", f"{folder}/{k}.lnk")
                if k % 50 == 8:
                    with open(f"{folder}/{k}.gdoc", "w") as f:
                        f.write(json.dumps({"url": f"doc/{k}", "id": int(k)}) if k % 100 == 8 else f"plain {k}")
            yield rows[["doc_id"]]

    rows = W.table(spark, d, "documents").select("doc_id", "source", "text").where("doc_id is not null")
    small_batches(rows).mapInPandas(write, "doc_id long").write.format("noop").mode("overwrite").save()
    return root


def _texts(files):
    return files.where(F.endswith("path", F.lit(".txt")))


#: The documents with what their files hold and where these are.
_N = "with n as (select doc_id, coalesce(text, '') as body, case when doc_id % 9 = 4 then 'Cache' else coalesce(source, 'none') end as folder, doc_id || '.txt' as name from documents where doc_id is not null) "


@query(_N + "select folder || '/' || name as path, strlen(body)::bigint as size, sha256(body) as digest from n where folder <> 'Cache'")
def walked_files(spark, d):
    root = _tree(spark, d)
    return _texts(walk.walk(spark, root, digest="sha256")).select(F.substring("path", len(root) + 2, 1000).alias("path"), "size", "digest")


@query(_N + """select p as provider, name, 'text/plain' as mime_type, 'code' as category, true as shortcut_allowed, strlen(body)::bigint as size, sha256(body) as sha256, p as source_type, 'tree' as source_label
 from n, (select unnest(['local', 'windows', 'wsl', 'gdrive', 'onedrive', 'dropbox']) as p) where not (p = 'local' and folder = 'Cache')""")
def provider_records(spark, d):
    root, out = _tree(spark, d), None
    for name in ("local", *providers.providers()):
        rows = _texts(providers.scan_local(spark, root) if name == "local" else providers.provider(name).scan(spark, root))
        rows = rows.select(F.lit(name).alias("provider"), F.substring_index("path", "/", -1).alias("name"), "mime_type", "category", "shortcut_allowed", "size", "sha256", "source_type", "source_label")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_N + """select doc_id || '.gdoc' as name, case when doc_id % 100 = 8 then '{"id": ' || doc_id || ', "url": "doc/' || doc_id || '"}' else 'plain ' || doc_id end as descriptor, false as stat_error from n where doc_id % 50 = 8
 union all select doc_id || '.lnk', null, true from n where doc_id % 50 = 7""")
def pointer_records(spark, d):
    """What a cloud drive's pointer files say, JSON or text, and the links that lead nowhere, whose records say that they could not be read."""
    rows = providers.provider("gdrive").scan(spark, _tree(spark, d))
    meta = F.from_json("metadata", "descriptor string, stat_error boolean")
    return rows.where(~F.endswith("path", F.lit(".txt"))).select(F.substring_index("path", "/", -1).alias("name"), meta["descriptor"].alias("descriptor"), F.coalesce(meta["stat_error"], F.lit(False)).alias("stat_error"))


@query(_N + "select name from n where folder <> 'Cache' and doc_id % 4 > 1")
def changed_files(spark, d):
    """What a resumed scan still has to read: files that are not done, or have another time."""
    files = cut(_texts(walk.walk(spark, _tree(spark, d))))
    k = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 4
    done = files.where(k < 2).select("path", "mtime").unionByName(files.where(k == 3).select("path", (F.col("mtime") - 1).alias("mtime")))
    return walk.changed(files, done).select("name")


@query(_N + "select folder, count(*) as files from n where folder <> 'Cache' group by 1")
def counted_roots(spark, d):
    """Files below several roots, one of them inside another and one not there, by folder."""
    root = _tree(spark, d)
    files = _texts(walk.walk_all(spark, [root, f"{root}/src1", "/no/such/folder", root]))
    return files.groupBy(F.substring_index(F.substring("path", len(root) + 2, 1000), "/", 1).alias("folder")).agg(F.count("*").alias("files"))


@query(_N + "select folder || '/' || name as path from n where folder not in ('src1', 'src2')")
def system_crawl(spark, d):
    """A crawl that leaves out what lies below given prefixes."""
    root = _tree(spark, d)
    files = walk.walk(spark, root, (), (f"{root}/src1", f"{root}/src2/", f"{root}/src"))
    return _texts(files).select(F.substring("path", len(root) + 2, 1000).alias("path"))


@query(_N + "select name, sha256(body) as digest, null::varchar as error from n")
def staged_scan(spark, d):
    root = _tree(spark, d)
    stages.run(spark, root, f"{root}-run")
    return _texts(stages.run(spark, root, f"{root}-run")).select(F.substring_index("path", "/", -1).alias("name"), "digest", "error")


@query(_N + """, g as (select sha256(body) as d, count(*) as n, strlen(any_value(body)) as size from n group by 1) select count(*) as files_total, sum(strlen(body))::bigint as bytes_total,
 (select count(*) from g) as distinct_digests, count(*) as files_digested, (select sum((n - 1) * size) from g)::bigint as bytes_in_copies, 0 as files_failed from n""")
def scan_summary(spark, d):
    """What a staged scan has found, in a row."""
    root = _tree(spark, d)
    digests = _texts(stages.run(spark, root, f"{root}-run"))
    return status.run_summary(_texts(Snapshots(spark, f"{root}-run/index").read()), digests).drop("newest_mtime")


@query(_N + """select path from (select folder || '/' || name as path from n union all select folder || '/' || doc_id || '.gdoc' from n where doc_id % 50 = 8) order by path limit 100""")
def scan_sample(spark, d):
    """The first hundred files by path, which the first stage of a scan keeps."""
    root = _tree(spark, d)
    return stages.sample(spark, root).select(F.substring("path", len(root) + 2, 1000).alias("path"))


@query(_N + "select name, '/sha256/' || sha256(body) as canonical, 'ok' as status from n")
def canonical_store(spark, d):
    root = _tree(spark, d)
    files = walk.digested(_texts(walk.walk(spark, root, ()))).select("path", "digest")
    done = canonical.materialize(canonical.plan(files, f"{root}-store"))
    return done.select(F.substring_index("path", "/", -1).alias("name"), F.regexp_extract("canonical_path", "/sha256/.*", 0).alias("canonical"), "status")


# ---- records and manifests


def _tree_records(spark, d):
    n = W.table(spark, d, "documents").where("doc_id is not null")
    name, text, k = F.concat(F.lit("/"), "doc_id"), F.coalesce("text", F.lit("")), F.col("doc_id")
    return n.select(
        F.concat(F.lit("u"), F.lpad(k.cast("string"), 9, "0")).alias("uuid7"), name.alias("path"), F.lit("s").alias("source"), F.octet_length(text).cast("long").alias("size"), F.lit(1.5).alias("mtime"), F.lit(420).alias("mode"),
        F.lit("sha256").alias("hash_algorithm"), F.when(k % 6 > 0, F.sha2(text, 256)).alias("blake3"), F.lit("user").alias("category"), F.lit("text/plain").alias("mime_type"), F.lit(True).alias("shortcut_allowed"), F.sha2(text, 256).alias("sha256"),
        F.lit("i").alias("source_id"), F.lit("local").alias("source_type"), F.lit("l").alias("source_label"), F.lit("v").alias("source_device_uuid"),
    )


@query(_N + "select 'u' || lpad(doc_id::varchar, 9, '0') as uuid7, '/' || doc_id as path, strlen(body)::bigint as size, n from n, (select unnest([1, 2])::bigint as n) where doc_id % 6 > 0")
def appended_records(spark, d):
    """Written twice and read back; records without a digest and broken lines are left out."""
    from pyspark.sql import Window

    at = f"{_folder(spark)}/r"
    for _ in range(2):
        manifests.write_records(_tree_records(spark, d), at)
    _tree_records(spark, d).select(F.concat(F.lit('{"path": broken '), "path").alias("value")).write.mode("append").text(at)
    return manifests.read_records(spark, at).select("uuid7", "path", "size", F.row_number().over(Window.partitionBy("uuid7").orderBy("path")).cast("long").alias("n"))


@query(_N + "select 'src' as source, '2026-01-01' as generated_at, '/' || doc_id as path, case when doc_id % 6 > 0 then sha256(body) end as blake3 from n")
def manifest_round_trip(spark, d):
    """A manifest is a document for one reader, so one task writes it, and one reads it."""
    at = f"{_folder(spark)}/m"
    rows = _tree_records(spark, d).select("path", "blake3", "uuid7", "category", "mime_type", "size")
    manifests.write_manifest(spark, rows, at, "src", "2026-01-01")
    header, records = manifests.read_manifest(spark, at)
    return records.select("path", "blake3").join(F.broadcast(header.select("source", "generated_at")))  # a manifest has one header


@query(_N + """select case k when 0 then 'an object' when 1 then 'no list' else 'broken' end as manifest, true as refused, (select count(*) from n) as others from (select unnest([0, 1, 2]) as k) where k > 0
 union all select 'an object', false, (select count(*) from n)""")
def bad_manifests(spark, d):
    """Of three manifests, two are no objects with a list of records, and reading them is an error."""
    others = W.table(spark, d, "documents").where("doc_id is not null").agg(F.count("*").alias("others"))
    out = None
    for name, text in (("an object", '{"source": "s", "records": [{"path": "/a"}]}'), ("no list", '{"source": "s"}'), ("broken", '{"source": "s", "records": [')):
        at = f"{_folder(spark)}/m"
        spark.createDataFrame([(text,)], "value string").write.text(at)
        try:
            refused = manifests.read_manifest(spark, at)[1].count() != 1
        except Exception as e:  # noqa: BLE001  how Spark wraps what a task raises depends on where it runs
            if "records" not in str(e) and "MALFORMED" not in str(e).upper():
                raise
            refused = True
        one = others.select(F.lit(name).alias("manifest"), F.lit(refused).alias("refused"), "others")
        out = one if out is None else out.unionByName(one)
    return out


@query(_N + "select '/' || doc_id as path, (2.0 + doc_id % 3)::double as mtime from n")
def completed_files(spark, d):
    """Files of lines: every path three times with other times, the last of which counts, and lines that are no records."""
    at = f"{_folder(spark)}/done"
    n = W.table(spark, d, "documents").where("doc_id is not null")
    times = F.posexplode(F.array(F.lit(9.0), F.lit(1.0), (2 + F.col("doc_id") % 3).cast("double")))
    lines = n.select("doc_id", times.alias("k", "mtime")).select("doc_id", "k", F.to_json(F.struct(F.concat(F.lit("/"), "doc_id").alias("path"), "mtime")).alias("value"))
    lines = lines.unionByName(n.select("doc_id", F.lit(3).alias("k"), F.lit("no line").alias("value")))
    lines.repartition("doc_id").sortWithinPartitions("doc_id", "k").select("value").write.text(at)
    return manifests.read_completed(spark, at)


@query(_N + "select doc_id as k, strlen(body)::bigint as size, folder as name from n union all select -1, 0, 'last line of ' || count(*) from n")
def arrays_and_tails(spark, d):
    """The objects of a JSON array, of which tasks read pieces, and the last line of a log, read from its end. An array is one file, which one task writes."""
    at = _folder(spark)
    n = W.table(spark, d, "documents").where("doc_id is not null")
    folder = F.when(F.col("doc_id") % 9 == 4, "Cache").otherwise(F.coalesce("source", F.lit("none")))
    rows = n.select(F.col("doc_id").alias("k"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"), folder.alias("name"))
    mark = lambda k, text: spark.createDataFrame([(k, text)], "o long, value string")
    items = numbered(rows, "k", name="o").select(F.col("o") + 1, F.concat(F.when(F.col("o") > 0, ",").otherwise(""), F.to_json(F.struct("k", "size", "name"))).alias("value")).toDF("o", "value")
    end = 2**62
    items.unionByName(mark(0, "[")).unionByName(mark(end, "]")).coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{at}/list")
    log = rows.select(F.col("k").alias("o"), F.lit("a line").alias("value")).unionByName(rows.agg(F.lit(end).alias("o"), F.concat(F.lit(" last line of "), F.count("*")).alias("value"))).unionByName(mark(end + 1, " "))
    log.coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{at}/log")
    only = lambda name: next(r[0] for r in spark.read.format("binaryFile").load(f"{at}/{name}/part-*").select("path").collect())  # noqa: E731  one file
    read = ranges.read_array(spark, only("list"), "k long, size long, name string", strict=True, piece=16 << 10)
    tail = spark.createDataFrame([(-1, 0, ranges.last_lines(only("log"))[0])], "k long, size long, name string")
    return read.select("k", "size", "name").unionByName(tail)


@query("select count(*) % 2 = 1 as enabled, 'after ' || count(*) as mode from documents")
def control_state(spark, d):
    """The state is written twice; the newest one counts."""
    at, schema = f"{_folder(spark)}/c", "enabled boolean, mode string"
    before = manifests.control_row(spark, at, '{"enabled": false, "mode": "off"}', schema).first()
    manifests.set_control(spark, at, {"enabled": before["enabled"], "mode": "hourly"}, schema)
    n = W.table(spark, d, "documents").count()
    manifests.set_control(spark, at, {"enabled": n % 2 == 1, "mode": f"after {n}"}, schema)
    return manifests.control_row(spark, at, "{}", schema)


@query("""select message_id, round_even(0.4 * len(list_intersect(regexp_split_to_array(lower(body_text), '[^\\p{L}\\p{N}]+'), ['please', 'the', 'und'])) / 3.0, 6)::double as score from message
 where len(list_intersect(regexp_split_to_array(lower(body_text), '[^\\p{L}\\p{N}]+'), ['please', 'the', 'und'])) > 0 order by score desc, message_id limit 50""")
def postings_search(spark, d):
    """The search of message_search, through inverted lists that are written first."""
    at = _folder(spark)
    postings.write(W.message(spark, d), at)
    return postings.search(spark, at, ["the", "und", "please"], k=50)


# ---- streams


#: Rows that a task writes to a file of a stream, unless that made more files than a batch takes.
A_FILE, FILES = 250_000, 800


def _stream(spark, rows, schema=None, files: int | None = None):
    """rows as a stream of JSON files of a new folder: so many, or by default as many as keep each small."""
    at = f"{_folder(spark)}/in"
    rows.repartition(files or min(FILES, max(4, -(-rows.count() // A_FILE)))).write.json(at)
    return spark.readStream.schema(schema or rows.schema).json(at), at


@query("""select provider_id as provider, source_id, path, content_hash, size::bigint as size from delta_event where event_type <> 'deleted' and content_hash is not null qualify row_number() over (partition by provider_id, source_id order by ord desc) = 1""")
def delta_stream_applied(spark, d):
    stream, at = _stream(spark, W.delta_event(spark, d))
    kept = Snapshots(spark, f"{at}-table")
    delta_stream.apply(delta_stream.events(spark, at), kept, f"{at}-cp").awaitTermination()
    return kept.read().select("provider", "source_id", "path", "content_hash", "size")


@query(_CHAIN + " select session_id, seq, h as event_hash from built")
def chain_stream_appended(spark, d):
    stream, at = _stream(spark, W.audit_record(spark, d), "session_id string, seq long, timestamp_uuid7 string, content_hash string, frame_id string")
    chain_stream.append(chain_stream.chained(stream), f"{at}-out", f"{at}-cp").awaitTermination()
    return spark.read.parquet(f"{at}-out").select("session_id", "seq", "event_hash")


@query("""select 'linux' as platform, mount_path, case when mount_path like '%one%' then 'onedrive' when mount_path like '%dropbox%' then 'dropbox' end as provider_hint from (select distinct '/mnt/' || provider || (ord % 6) as mount_path from file_instance)""")
def mounts_arrived(spark, d):
    """Listings come in two files; each mount is acted on once."""
    rows = W.file_instance(spark, d).select(F.concat(F.lit("/mnt/"), "provider", (F.col("ord") % 6).cast("string")).alias("mount_path"))
    stream, at = _stream(spark, rows, files=2)
    listings = spark.readStream.schema("mount_path string").option("maxFilesPerTrigger", 1).json(at)
    delta_stream.on_arrival(listings, Snapshots(spark, f"{at}-known"), lambda found: found.write.mode("append").parquet(f"{at}-acted"), f"{at}-cp").awaitTermination()
    return spark.read.parquet(f"{at}-acted")


@query("select event_type, count(*) as n from events where event_type in ('view', 'click') group by 1 union all select 'all', count(*) from events")
def topics_routed(spark, d):
    stream, at = _stream(spark, W.table(spark, d, "events").select("event_id", "event_type"))
    sink = lambda name: lambda rows: rows.write.mode("append").json(f"{at}-{name}")
    delta_stream.by_topic(stream, {t: sink(t) for t in ("view", "click")}, f"{at}-cp", log=f"{at}-all").awaitTermination()
    count = lambda name: spark.read.schema("event_id long, event_type string").json(f"{at}-{name}").agg(F.lit(name).alias("event_type"), F.count("*").alias("n"))
    return count("view").unionByName(count("click")).unionByName(count("all"))


# ---- plug-ins


@query("""with o as (select 'p' || lpad(o_custkey::varchar, 9, '0') as provider_id, o_orderkey as k from orders), s as (select *, coalesce(cursor, '') <> '' as more from sync_state)
select provider_id, case when any_value(more) then 'incremental' else 'full' end as strategy, count(k) as event_count, case when any_value(more) then any_value(cursor) || '+' else coalesce('c' || max(k), any_value(cursor)) end as new_cursor
 from s left join o using (provider_id) where not more or k is null or k % 2 = 0 group by provider_id
union all select provider_id, 'incremental', 0, any_value(cursor) || '+' from s left join o using (provider_id) where more group by provider_id having count(k) > 0 and count(*) filter (where k % 2 = 0) = 0""")
def providers_synced(spark, d):
    """All providers by their cursors, as one job: a full snapshot has all events, those after a cursor are the even ones here."""
    orders = W.table(spark, d, "orders").select(F.concat(F.lit("p"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("provider_id"), F.col("o_orderkey").alias("k"))
    full = lambda own: (own.join(orders, "provider_id"), own.join(orders, "provider_id").groupBy("provider_id").agg(F.concat(F.lit("c"), F.max("k")).alias("new_cursor")))
    more = lambda own: (own.join(orders.where("k % 2 = 0"), "provider_id"), own.select("provider_id", F.concat("cursor", F.lit("+")).alias("new_cursor")))
    return delta.sync_providers(W.sync_state(spark, d), full, more)


@query("""with c as (select source_id, unnest(string_split(content_hash, '')) as c from file_instance), n as (select source_id, ascii(c) // 16 as pos, count(*) as n from c group by all), z as (select source_id, sqrt(sum(n * n)) as z from n group by 1)
select source_id, pos::int as pos, round(n / z, 9) as value from n join z using (source_id)""")
def encoded_payloads(spark, d):
    """Any object with encode(payload, mime_type) as the embedding model; here counts of bytes in 16 bins."""
    from tallyframe.functions.vectors import ByteHistogram, encode

    i = W.file_instance(spark, d)
    e = i.select("source_id", encode(F.col("content_hash"), F.col("mime_type"), ByteHistogram(16)).alias("v"))
    return e.select("source_id", F.posexplode("v").alias("pos", "value")).where("value > 0").withColumn("value", F.round("value", 9))


@query("""select provider, row_number() over (partition by provider order by event_id) - 1 as number, event_id, event_type, sha256(event_type || event_id) as content_hash
 from (select *, 'p' || user_id % 4 as provider from events)""")
def captured_frames(spark, d):
    """Events as frames of four providers: a feed of folders, whose pieces tasks read, in two runs from one checkpoint."""
    at = _folder(spark)
    rows = W.table(spark, d, "events").select(F.concat(F.lit("p"), F.col("user_id") % 4).alias("provider"), "event_id", "event_type")
    placed = cut(numbered(rows, "provider", "event_id", name="place"))
    first = F.broadcast(placed.groupBy("provider").agg(F.min("place").alias("first")))  # a row for each provider
    frames = placed.join(first, "provider").withColumn("number", F.col("place") - F.col("first")).drop("place", "first")
    feed.FolderFeed.write(frames, f"{at}/feed", 500)
    for most in (700, 0):
        stream = feed.stream(spark, lambda folder=f"{at}/feed": feed.FolderFeed(folder, 500, ("event_id", "event_type")), "event_id long, event_type string", most=most, piece=200)
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.select("provider", "number", "event_id", "event_type", F.sha2(F.concat("event_type", F.col("event_id").cast("string")), 256).alias("content_hash"))


_RUNS = """ms as (select user_id::varchar as session_id, event_id, epoch_us(ts) // 1000 as m from events), b as (select *, coalesce(m - lag(m) over w >= 21600000, true) as fresh from ms window w as (partition by session_id order by m)),
r as (select *, sum(fresh::int) over (partition by session_id order by m, event_id) as k from b)"""


@query(f"""with {_RUNS} select session_id, min(m) as started, max(m) as stopped, count(*) as frames, 'silence' as closed_by from r group by session_id, k having max(m) + 21600000 <= (select max(m) from ms) - 3600000""")
def recorder_stopped(spark, d):
    """Sessions of users that a timer has stopped after six hours without an event; those that may go on are still open."""
    stream, at = _stream(spark, W.table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts")))
    own = spark.newSession()  # timers need a state store of their own kind, which is a setting of the session
    own.conf.set(*recorder.STORE)
    frames = own.readStream.schema("session_id string, ts timestamp").json(at)
    recorder.sessions(frames, "6 hours", "1 hour").writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}-out")


@query("""select event_type, epoch_us(start) as start, count(*) as n, round(sum(value), 4) as total from (
 select *, unnest([time_bucket(interval '1 hour', ts) - interval 1 hour, time_bucket(interval '1 hour', ts)]) as start from events) group by all""")
def sliding_windows(spark, d):
    rows = windows.sliding(W.table(spark, d, "events"), "2 hours", "1 hour")
    return rows.select("event_type", F.unix_micros("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""with b as (select *, coalesce(ts - lag(ts) over w >= interval 1 hour, true) as fresh from events window w as (partition by user_id order by ts)),
n as (select *, sum(fresh::int) over (partition by user_id order by ts, event_id) as k from b) select user_id, epoch_us(min(ts)) as start, count(*) as n from n group by user_id, k""")
def session_windows(spark, d):
    return windows.sessions(W.table(spark, d, "events"), "1 hour").select("user_id", F.unix_micros("start").alias("start"), "n")


@query("""select a.event_id as left_id, b.event_id as right_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 2 hours""")
def paired_events(spark, d):
    """Clicks with purchases of the same user within two hours."""
    e = W.table(spark, d, "events")
    return windows.paired(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "2 hours").select("left_id", "right_id")


@query(_N + "select name as path, case when doc_id % 5 = 0 then 'ValueError: refused' end as error from n")
def hooked_records(spark, d):
    """A hook is called for every record; one that fails leaves its error and does not stop the others."""
    rows = W.table(spark, d, "documents").where("doc_id is not null").select(F.concat("doc_id", F.lit(".txt")).alias("path"), "doc_id")
    return canonical.call_hook(rows, _refuse_fifths).select("path", "error")


def _refuse_fifths(record: dict) -> None:
    if record["doc_id"] % 5 == 0:
        raise ValueError("refused")


@query("select doc_id as k, source as name from documents")
def migrated_table(spark, d):
    """Files of statements are applied in the order of their names, once: the second creates what the first one needs not have."""
    at = _folder(spark)
    name = f"migrated_{at.rsplit('/', 1)[1]}"
    os.makedirs(f"{at}/sql")
    for k, text in ((2, f"create table {name} (k long, name string)\n using parquet location 'file:{at}/t';\n"), (1, f"drop table if exists {name};\nselect ';';")):
        with open(f"{at}/sql/{k:03d}.sql", "w") as f:  # two files of a few words
            f.write(text)
    if manifests.migrate(spark, f"{at}/sql", f"{at}/history") != ["001.sql", "002.sql"]:
        raise ValueError("migrations out of order")
    W.table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("source").alias("name")).write.insertInto(name)
    if manifests.migrate(spark, f"{at}/sql", f"{at}/history"):
        raise ValueError("a migration was applied twice")
    rows = spark.read.parquet(f"file:{at}/t")
    spark.sql(f"drop table {name}")  # its files stay
    return rows
