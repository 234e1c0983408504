"""The registered queries: an operator over the views, and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import classify as K
from tallyframe.functions import ids, paths, times
from tallyframe.operators import chain, chat, delta, duplicates, ingest, lookup, moves, reporting, similarity, status, versions
from tallyframe.plans import views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL over tables and views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = W.with_views(sql)
        return f

    return add


# ---- duplicates


@query("""select content_hash, size, mime_type, count(*) as n, min(ord) as first_ord, min(canonical_id) as canonical_id, string_agg(distinct provider, ',' order by provider) as providers
from file_instance where deleted_at is null group by all having count(*) > 1""")
def duplicate_groups(spark, d):
    return duplicates.duplicate_groups(W.file_instance(spark, d)).withColumn("providers", F.array_join("providers", ","))


@query("select ord, instance_id, provider, path from file_instance where deleted_at is null and size > 0 and content_hash = (select min(content_hash) from file_instance where ord = (select min(ord) from file_instance))")
def duplicates_for_hash(spark, d):
    i = W.file_instance(spark, d)
    first = i.groupBy().agg(F.min_by("content_hash", "ord").alias("h")).first()
    return duplicates.duplicates_for_hash(i, first["h"]).where("size > 0").select("ord", "instance_id", "provider", "path")


@query("""select instance_id, case when n > 1 and deleted_at is null then first else canonical_id end as canonical_id from (
  select *, count(*) filter (where deleted_at is null) over w as n, arg_min(instance_id, ord) filter (where deleted_at is null) over w as first
  from file_instance window w as (partition by content_hash, size, mime_type))""")
def unify_duplicates(spark, d):
    return duplicates.unify_all(W.file_instance(spark, d)).select("instance_id", "canonical_id")


@query("""with g as (select content_hash, size, mime_type, count(*) as n, min(ord) as first_ord from file_instance where deleted_at is null group by all having count(*) > 1)
select instance_id, n, first_ord from file_instance join g using (content_hash, size, mime_type) where deleted_at is null""")
def duplicate_members(spark, d):
    return duplicates.members(W.file_instance(spark, d)).select("instance_id", "n", "first_ord")


@query("""with g as (select content_hash, size, mime_type, count(*) as n, min(ord) as first_ord, list_sort(list_distinct(list(provider))) as p from file_instance where deleted_at is null group by all having count(*) > 1),
r as (select row_number() over (order by n desc, first_ord) as k, * from g)
select k + 1 as line_no, k || '. hash=' || content_hash || ' size=' || size || ' mime=' || mime_type || ' instances=' || n || ' providers=[' || list_aggregate(list_transform(p, lambda x: '''' || x || ''''), 'string_agg', ', ') || ']' as line from r
union all select k, case when (select count(*) from r) = 0 then 'No duplicate groups detected.' when k = 0 then 'Duplicate Groups' else '================' end from range(2) t(k) where k = 0 or (select count(*) from r) > 0""")
def duplicate_report(spark, d):
    return reporting.duplicate_report(duplicates.duplicate_groups(W.file_instance(spark, d)))


# ---- classification and paths

_CLASSIFIED = f"""parts as (select ord, path, regexp_extract(path, '[^/]*$') as name, coalesce(list_filter(string_split(path, '/'), lambda x: x <> '')[-2], '') as parent from file_instance),
s as (select *, lower(regexp_extract(name, '(?s)^.+(\\.[^.]+)$', 1)) as sfx, lower(regexp_extract(regexp_replace(name, '\\.[^.]+$', ''), '(?s)^.+(\\.[^.]+)$', 1)) as inner_sfx from parts),
m as (select *, {W._mime_sql()} as mime_type from s),
c as (select *, case when lower(name) in {K.SYSTEM_NAMES} or name like '.%' or name like '~$%' or lower(parent) in {K.SYSTEM_PARENTS} then 'system'
  when sfx in {K.CODE} or mime_type like 'text/%' or mime_type like 'application/json%' or mime_type like 'application/xml%' then 'code'
  when sfx in {K.MEDIA} or mime_type like 'image/%' or mime_type like 'audio/%' or mime_type like 'video/%' then 'media'
  when mime_type = 'application/octet-stream' then 'binary' else 'user' end as category from m)"""


def _classified(spark, d):
    i = W.file_instance(spark, d).select("ord", "path").withColumn("mime_type", K.mime_type(F.col("path")))
    return i.withColumn("category", K.category(F.col("path"), F.col("mime_type")))


@query(f"with {_CLASSIFIED} select ord, name, parent, sfx as suffix, mime_type, category, category not in ('system', 'binary') as shortcut_allowed from c")
def classify_files(spark, d):
    p = F.col("path")
    return _classified(spark, d).select("ord", paths.base_name(p).alias("name"), paths.parent_name(p).alias("parent"), paths.suffix(p).alias("suffix"), "mime_type", "category", K.shortcut_allowed(F.col("category")).alias("shortcut_allowed"))


@query(f"with {_CLASSIFIED} select category, count(*) as count from c group by category")
def category_counts(spark, d):
    return status.category_counts(_classified(spark, d))


@query(f"with {_CLASSIFIED} select count(*) as total, count(*) filter (where category = 'canonical') as canonical_count, count(*) filter (where category not in ('system', 'binary')) as shortcut_count from c")
def manifest_counts(spark, d):
    return status.manifest_counts(_classified(spark, d).withColumn("shortcut_allowed", K.shortcut_allowed(F.col("category"))))


@query("""with n as (select count(*) as total, count(*) filter (where deleted_at is null) as live from file_instance)
select total as filesystem_count, 100::bigint as stage1_count, live as stage2_count, 0::bigint as stage3_count, total as db_indexed_count, 0::bigint as canonical_count, live as shortcut_count,
 round_even(live / total::double * 100, 2) as scanner_progress, round_even(total / live::double * 100, 2) as processed_progress, 100.0::double as ingestion_progress from n""")
def pipeline_status(spark, d):
    i = W.file_instance(spark, d)
    live = duplicates.live(i).count()
    state = spark.createDataFrame([(2, 100, live, None, 0, 0, True, None, None, None, None, None)], status.STATE)
    records = i.select(F.lit("user").alias("category"), F.col("deleted_at").isNull().alias("shortcut_allowed"))
    return status.pipeline_status(state, records, i)


@query("""select ord, '/mnt/' || lower(chr(99 + (ord % 5)::int)) || path as wsl, upper(chr(99 + (ord % 5)::int)) || ':\\' || replace(ltrim(path, '/'), '/', '\\') as windows,
 upper(chr(99 + (ord % 5)::int)) || ':\\' || replace(ltrim(path, '/'), '/', '\\') as back, '\\\\?\\' || upper(chr(99 + (ord % 5)::int)) || ':\\' || replace(ltrim(path, '/'), '/', '\\') as extended, 'wsl' as source_type,
 case when provider = 'onedrive' then 'onedrive' when provider = 'dropbox' then 'dropbox' end as hint from file_instance""")
def path_forms(spark, d):
    drive = F.element_at(F.array(*map(F.lit, "cdefg")), (F.col("ord") % 5 + 1).cast("int"))
    rows = W.file_instance(spark, d).select("ord", "provider", F.concat(F.lit("/mnt/"), drive, "path").alias("wsl"))
    rows = rows.withColumn("windows", paths.wsl_to_windows(F.col("wsl")))
    back = paths.wsl_to_windows(paths.windows_to_wsl(F.col("windows")))
    hint = paths.provider_hint(F.concat(F.lit("/media/My "), F.col("provider")))
    return rows.select("ord", "wsl", "windows", back.alias("back"), paths.extended_length(F.col("windows")).alias("extended"), paths.source_type(F.lit("wsl"), F.col("wsl")).alias("source_type"), hint.alias("hint"))


@query("""select event_id, ms, ms as back from (select event_id, epoch_us(ts) // 1000 as ms from events)""")
def uuid7_time(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = W.table(spark, d, "events").select("event_id", ms.alias("ms"))
    return rows.select("event_id", "ms", ids.id_millis(ids.id_at(F.col("ms"), F.col("event_id").cast("string"))).alias("back"))


@query("""with m as (select distinct '/mnt/' || provider || (ord % 40) as mount_path, ord % 40 as k from file_instance)
select 'linux' as platform, mount_path, case when lower(regexp_extract(mount_path, '[^/]*$')) like '%google%' then 'gdrive' when mount_path like '%one%' then 'onedrive' when mount_path like '%dropbox%' then 'dropbox' end as provider_hint from m where k >= 30""")
def mount_events(spark, d):
    m = W.file_instance(spark, d).select(F.concat(F.lit("/mnt/"), "provider", (F.col("ord") % 40).cast("string")).alias("mount_path"), (F.col("ord") % 40).alias("k"))
    return lookup.new_mounts(m.where("k < 30"), m)


@query("""select 'z://' || source_id as z_path, case when ord % 4 = 0 then null else source_id end as uuid7, case when ord % 4 > 1 then path end as path,
 case when ord % 4 = 0 then 'z path missing uuid7 value' when ord % 4 = 1 then 'unknown uuid7: ' || source_id end as error from (select ord, case when ord % 4 = 0 then ' ' else source_id end as source_id, path from file_instance)""")
def resolve_z_paths(spark, d):
    i = W.file_instance(spark, d)
    wanted = i.select(F.concat(F.lit("z://"), F.when(F.col("ord") % 4 == 0, " ").otherwise(F.col("source_id"))).alias("z_path"))
    return lookup.resolve_z_paths(wanted, i.where("ord % 4 > 1").select(F.col("source_id").alias("uuid7"), "path")).select("z_path", "uuid7", "path", "error")


# ---- versions

_PAIRS = "p as (select * from previous_snapshot), c as (select * from current_snapshot)"


@query(f"""with {_PAIRS} select source_id, case when p.content_hash = c.content_hash and p.size = c.size then case when p.path = c.path and p.provider = c.provider then 'unchanged' else 'same_version_new_location' end
 when p.path = c.path and p.provider = c.provider then 'new_version_same_path' else 'new_canonical_object' end as change_type,
 case when (p.content_hash = c.content_hash and p.size = c.size) or (p.path = c.path and p.provider = c.provider) then p.canonical_id end as canonical_id from p join c using (source_id)""")
def version_change(spark, d):
    old = W.previous_snapshot(spark, d).select("source_id", F.struct("*").alias("old"))
    new = W.current_snapshot(spark, d).select("source_id", F.struct("*").alias("new"))
    return versions.classify_pairs(old.join(new, "source_id")).select("source_id", "change_type", "canonical_id")


@query("""select version_id, canonical_id, lag(version_id) over w as parent_version_id, row_number() over w as position, count(*) over (partition by canonical_id) as version_count
 from file_version window w as (partition by canonical_id order by created_at, ord)""")
def version_history(spark, d):
    return versions.history(versions.link(W.file_version(spark, d))).select("version_id", "canonical_id", "parent_version_id", "position", "version_count")


@query("""select version_id, first_value(version_id) over w as root_id, row_number() over w - 1 as depth from file_version window w as (partition by canonical_id order by created_at, ord)""")
def lineage_depth(spark, d):
    return versions.depths(versions.link(W.file_version(spark, d)))


@query("""with e as (select canonical_id, count(*) as top from file_version where ord % 3 = 0 group by 1)
select version_id, (coalesce(top, 0) + row_number() over (partition by v.canonical_id order by ord))::int as version_number from file_version v left join e using (canonical_id) where ord % 3 <> 0""")
def next_version_number(spark, d):
    v = W.file_version(spark, d).withColumnRenamed("canonical_id", "file_id")
    old = v.where("ord % 3 = 0")
    old = versions.next_numbers(spark.createDataFrame([], "file_id string, version_number int"), old)
    return versions.next_numbers(old, v.where("ord % 3 <> 0")).select("version_id", "version_number")


# ---- moves, deltas, drift

_MOVES = f"""{_PAIRS},
lp as (select content_hash, provider, path, device_id, max(ord) as ord from p group by all), lc as (select content_hash, provider, path, device_id, max(ord) as ord, arg_max(instance_id, ord) as instance_id, arg_max(canonical_id, ord) as canonical_id from c group by all),
gone as (select *, row_number() over (partition by content_hash order by ord, provider, path, device_id) as rn from lp where content_hash in (select content_hash from lc)
  and not exists (select 1 from lc where lc.content_hash = lp.content_hash and lc.provider = lp.provider and lc.path = lp.path and lc.device_id is not distinct from lp.device_id)),
fresh as (select *, row_number() over (partition by content_hash order by ord, provider, path, device_id) as rn from lc where content_hash in (select content_hash from lp)
  and not exists (select 1 from lp where lc.content_hash = lp.content_hash and lc.provider = lp.provider and lc.path = lp.path and lc.device_id is not distinct from lp.device_id)),
ev as (select 'move' as event_type, f.content_hash, f.instance_id, g.provider as from_provider, g.path as from_path, g.device_id as from_device_id, f.provider as to_provider, f.path as to_path, f.device_id as to_device_id from fresh f join gone g using (content_hash, rn)
  union all select 'copy', f.content_hash, f.instance_id, a.provider, a.path, a.device_id, f.provider, f.path, f.device_id from fresh f join (select content_hash, arg_min(provider, ord) as provider, arg_min(path, ord) as path, (arg_min({{'d': device_id}}, ord)).d as device_id from p group by 1) a using (content_hash)
  where content_hash not in (select content_hash from gone))"""


def _events(spark, d):
    return moves.detect(W.previous_snapshot(spark, d), W.current_snapshot(spark, d))


@query(f"with {_MOVES} select * from ev")
def detect_moves(spark, d):
    return _events(spark, d).select("event_type", "content_hash", "instance_id", *(f"{s}_{c}" for s in ("from", "to") for c in moves.LOCATION))


@query(f"""with {_MOVES} select event_type, content_hash, from_provider || ':' || from_path as "from", to_provider || ':' || to_path as "to" from ev""")
def move_audit_log(spark, d):
    return moves.audit_log(_events(spark, d)).drop("event_id")


@query(f"""with {_MOVES} select p.instance_id, coalesce(e.to_provider, p.provider) as provider, coalesce(e.to_path, p.path) as path, case when e.instance_id is null then p.device_id else e.to_device_id end as device_id
 from p left join (select * from ev where event_type = 'move') e using (instance_id)""")
def apply_moves(spark, d):
    return moves.apply_moves(W.previous_snapshot(spark, d), _events(spark, d)).select("instance_id", "provider", "path", "device_id")


_CUR = "cur as (select provider as provider_id, source_id, arg_max(instance_id, ord) as instance_id, arg_max(modified_at, ord) as known_at, (arg_max({'d': device_id}, ord)).d as known_device from file_instance group by 1, 2)"


@query(f"""with {_CUR} select e.ord, coalesce(cur.instance_id, 'n-' || sha256(provider_id || '|' || source_id || '|' || e.ord)) as instance_id, source_id, provider_id as provider, e.path, e.content_hash, e.size::bigint as size,
 coalesce(nullif(e.modified_at, ''), known_at, '') as modified_at, coalesce(nullif(e.device_id, ''), known_device) as device_id
 from delta_event e left join cur using (provider_id, source_id) where event_type <> 'deleted' and e.content_hash is not null""")
def delta_upserts(spark, d):
    return delta.upserts(W.delta_event(spark, d), W.file_instance(spark, d)).select("ord", "instance_id", "source_id", "provider", "path", "content_hash", F.col("size").cast("long").alias("size"), "modified_at", "device_id")


@query(f"with {_CUR} select e.ord, cur.instance_id from delta_event e join cur using (provider_id, source_id) where event_type = 'deleted'")
def delta_deletions(spark, d):
    return delta.deletions(W.delta_event(spark, d), W.file_instance(spark, d))


@query("select ord, event_type, source_id from delta_event where event_type in ('moved', 'renamed')")
def delta_moves(spark, d):
    return delta.moves(W.delta_event(spark, d)).select("ord", "event_type", "source_id")


@query("""select coalesce(p.source_id, c.source_id) as source_id, case when p.source_id is null then 'missing_in_provider' when c.source_id is null then 'missing_in_inventory' else 'hash_mismatch' end as drift
 from current_snapshot p full join (select * from previous_snapshot where provider = 'gdrive') c on p.source_id = c.source_id where p.source_id is null or c.source_id is null or p.content_hash <> c.content_hash""")
def reconcile_drift(spark, d):
    return delta.reconcile("gdrive", W.current_snapshot(spark, d), W.previous_snapshot(spark, d))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def latest_by_key(spark, d):
    return delta.last_by_key(W.table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", order="event_id")


@query("""select *, case when coalesce(cursor, '') <> '' then 'incremental' else 'full' end as strategy, last_error is null as healthy, count(*) over () as provider_count, count(*) filter (where last_error is null) over () as healthy_count from sync_state""")
def sync_dashboard(spark, d):
    s = W.sync_state(spark, d)
    return reporting.sync_dashboard(s.withColumn("strategy", delta.strategy(F.col("cursor"))))


# ---- chains


def _events_of(spark, d):
    """Chains with some events tampered with."""
    built = chain.build(W.audit_record(spark, d))
    bad = F.pmod(F.substring("session_id", 2, 9).cast("long"), F.lit(5)) == 2
    return built.withColumn("event_hash", F.when(bad & (F.col("seq") == 4), F.lit("0" * 64)).otherwise(F.col("event_hash")))


_CHAIN = """with recursive r as (select * from audit_record),
built(session_id, seq, h) as (
  select session_id, seq, sha256('{"blake3_hash":"' || content_hash || '","frame_id":"' || frame_id || '","previous_event_hash":null,"timestamp_uuid7":"' || timestamp_uuid7 || '"}') from r where seq = 1
  union all select r.session_id, r.seq, sha256('{"blake3_hash":"' || content_hash || '","frame_id":"' || frame_id || '","previous_event_hash":"' || h || '","timestamp_uuid7":"' || timestamp_uuid7 || '"}') from built b join r on r.session_id = b.session_id and r.seq = b.seq + 1)"""


@query(_CHAIN + " select session_id, seq, h as event_hash from built")
def chain_build(spark, d):
    return chain.build(W.audit_record(spark, d)).select("session_id", "seq", "event_hash")


@query("""select session_id, n, not bad as chain_valid, case when bad then 3 else n end as valid_prefix from (select session_id, count(*) as n, substr(session_id, 2)::bigint % 5 = 2 and count(*) >= 4 as bad from audit_record group by 1)""")
def chain_verify(spark, d):
    return chain.verify(_events_of(spark, d))


# ---- similarity

_NEAR = """with f as (select * from fingerprint),
s as (select a.ord as a_ord, b.ord as b_ord, a.file_id as a, b.file_id as b, 0.7 * greatest(-1, least(1, list_cosine_similarity(a.embedding, b.embedding)))
  + 0.3 * (1 - (list_sum(list_transform(list_zip(a.ab || a.db || a.pb, b.ab || b.db || b.pb), lambda x: abs(x[1] - x[2])))) / 192.0) as score from f a join f b on a.ord < b.ord)"""


_HEX = "list_aggregate(list_transform(range(16), lambda i: substr('0123456789abcdef', 8 * {0}[4 * i + 1] + 4 * {0}[4 * i + 2] + 2 * {0}[4 * i + 3] + {0}[4 * i + 4] + 1, 1)), 'string_agg', '')"


@query(f"select file_id, {_HEX.format('ab')} as a_hash, {_HEX.format('db')} as d_hash, {_HEX.format('pb')} as p_hash from fingerprint")
def perceptual_hashes(spark, d):
    return W.fingerprint(spark, d).select("file_id", "a_hash", "d_hash", "p_hash")


@query(_NEAR + " select a, b, round_even(score, 6) as score from s where score >= 0.45")
def similar_pairs(spark, d):
    return similarity.pairs(W.fingerprint(spark, d), 0.45).select("a", "b", F.bround("score", 6).alias("score"))


@query(_NEAR + """, r as (select a as file_id, b as other, b_ord as o, round_even(score, 6) as score from s where score >= 0.4 union all select b, a, a_ord, round_even(score, 6) from s where score >= 0.4)
 select file_id, rank, other, score from (select *, (row_number() over (partition by file_id order by score desc, o))::int as rank from r) where rank <= 5""")
def top_similar(spark, d):
    return similarity.top_similar(W.fingerprint(spark, d), 0.4, 5)


@query(_NEAR.replace("with f as", "with recursive f as") + """, e as (select a, b from s where score >= 0.5 union select b, a from s where score >= 0.5),
 reach(x, y) as (select a, b from e union select reach.x, e.b from reach join e on reach.y = e.a)
 select 'c' || substr(least(x, min(y)), 2) as cluster_id, 'c' || substr(x, 2) as canonical_file_id from reach group by x""")
def similarity_clusters(spark, d):
    return similarity.cluster_members(W.fingerprint(spark, d), 0.5)


@query("""with x as (select label, generate_subscripts(embedding, 1) as k, unnest(embedding::double[]) as v from embeddings), m as (select label, k, avg(v) as v from x group by 1, 2),
 n as (select label, sqrt(sum(v * v)) as n from m group by 1) select label, (k - 1)::int as pos, round(v / n, 9) as value from m join n using (label)""")
def mean_embeddings(spark, d):
    from tallyframe.functions.vectors import mean_unit

    mean = mean_unit(W.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding")), "label")
    return mean.select("label", F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.round("value", 9))


# ---- ingestion

_DOCS = f"""docs as (select ord, 'd' || lpad((ord - ord % 20 % 2)::varchar, 9, '0') as uuid7, case when ord % 23 <> 4 then path end as path, case when ord % 29 <> 6 then content_hash end as blake3, 'user' as category, mime_type from file_instance),
ok as (select * from docs where path is not null and blake3 is not null)"""


def _records(spark, d):
    i = W.file_instance(spark, d)
    twice = F.concat(F.lit("d"), F.lpad((F.col("ord") - F.col("ord") % 20 % 2).cast("string"), 9, "0"))
    return i.select("ord", twice.alias("uuid7"), F.when(F.col("ord") % 23 != 4, F.col("path")).alias("path"), F.when(F.col("ord") % 29 != 6, F.col("content_hash")).alias("blake3"), F.lit("user").alias("category"), "mime_type", "size")


@query(f"with {_DOCS} select uuid7, path, '' as canonical_path, blake3 as hash, category, mime_type from (select *, row_number() over (partition by uuid7, blake3 order by path, category, mime_type) as n from ok) where n = 1")
def graph_nodes(spark, d):
    return ingest.nodes(_records(spark, d))


@query(f"with {_DOCS} select distinct uuid7 as source, blake3 as target, 'HAS_HASH' as edge_type from ok")
def graph_edges(spark, d):
    return ingest.edges(_records(spark, d))


@query(f"""with {_DOCS} select sha256(path) as identifier, list_aggregate(list_transform(range(16), lambda i: printf('%.6f', round_even(('0x' || substr(sha256(path), 2 * i + 1, 2))::int / 255.0::double, 6))), 'string_agg', ',') as vector from ok""")
def text_embeddings(spark, d):
    found = ingest.embeddings(_records(spark, d), distinct=False)
    return found.select("identifier", F.array_join(F.transform("vector", lambda x: F.format_string("%.6f", x)), ",").alias("vector"))


@query(f"with {_DOCS} select uuid7 as record, 'record missing keys: ' || concat_ws(', ', case when blake3 is null then 'blake3' end, case when path is null then 'path' end) as error from docs where path is null or blake3 is null")
def manifest_errors(spark, d):
    return ingest.errors(_records(spark, d))


@query(f"with {_DOCS} select sha256('b1/' || ord) as id, uuid7 as file_id, (row_number() over (partition by uuid7 order by ord))::int as version_number, blake3 as digest from docs")
def ingest_versions(spark, d):
    rows = _records(spark, d).withColumns({"source": F.lit("s"), "hash_algorithm": F.lit("sha256"), "sha256": F.lit(""), "mtime": F.lit(0.0), "mode": F.lit(0), "shortcut_allowed": F.lit(True)})
    made = ingest.table_rows(rows, "b1", spark.createDataFrame([], "file_id string, version_number int"))
    return made["versions"].select("id", "file_id", "version_number", "digest")


@query("""select provider, source_id, path, content_hash from (select provider, source_id, path, content_hash, 1 as fresh, ord from current_snapshot union all select provider, source_id, path, content_hash, 0, ord from previous_snapshot)
 qualify row_number() over (partition by provider, source_id order by fresh desc, ord desc) = 1""")
def keyed_merge(spark, d):
    from tallyframe.operators.merge import merge

    columns = ["provider", "source_id", "path", "content_hash"]
    return merge(W.previous_snapshot(spark, d).select(columns), W.current_snapshot(spark, d).select(*columns, "ord"), ["provider", "source_id"])


# ---- reports over time


@query("select 12.5::double as elapsed_seconds, round_even(b / 12.5, 2) as bytes_per_second, round_even(n / 12.5, 2) as files_per_second, round_even(b / 12.5 / 1048576.0, 3) as mb_per_second from (select sum(size)::double as b, count(*)::double as n from file_instance)")
def throughput_summary(spark, d):
    return reporting.throughput_summary(W.file_instance(spark, d), 12.5)


@query("""select event_id, round(avg(value) over (w rows between 29 preceding and current row), 6) as moving_average, max(value) over (w rows between unbounded preceding and current row) as peak
 from events window w as (partition by user_id order by ts, event_id)""")
def moving_average(spark, d):
    rows = reporting.moving_average(W.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")
    return rows.select("event_id", F.round("moving_average", 6).alias("moving_average"), "peak")


@query("""select event_type, time_bucket(interval '1 hour', ts)::timestamp as start, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_windows(spark, d):
    from tallyframe.streaming.windows import tumbling

    rows = tumbling(W.table(spark, d, "events"), "1 hour")
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


# ---- messages


@query("select message_id, source_channel, source_message_id, role, trim(regexp_replace(body_text, '\\s+', ' ', 'g')) as body_text from message qualify row_number() over (partition by source_channel, source_message_id order by ingested_at desc, message_id) = 1")
def distinct_messages(spark, d):
    return chat.normalized(chat.distinct_messages(W.message(spark, d))).select("message_id", "source_channel", "source_message_id", "role", "body_text")


@query("""select message_id, round_even(0.4 * len(list_intersect(regexp_split_to_array(lower(body_text), '[^\\p{L}\\p{N}]+'), ['please', 'the', 'und'])) / 3.0, 6)::double as score from message
 where len(list_intersect(regexp_split_to_array(lower(body_text), '[^\\p{L}\\p{N}]+'), ['please', 'the', 'und'])) > 0 order by score desc, message_id limit 50""")
def message_search(spark, d):
    return chat.search(W.message(spark, d), ["the", "und", "please"], k=50).select("message_id", "score")


@query("""select c_custkey, case when c_acctbal < 0 then '–' else (c_acctbal::bigint // 3600) || ':' || lpad(((floor(c_acctbal)::bigint % 3600) // 60)::varchar, 2, '0') || ':' || lpad((floor(c_acctbal)::bigint % 60)::varchar, 2, '0') end as clock,
 case when c_custkey = 0 then 100.0 else round_even(c_custkey % 7 / c_custkey::double * 100, 2) end as progress from (select c_custkey, floor(c_acctbal) as c_acctbal from customer)""")
def display_times(spark, d):
    c = W.table(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("s"))
    return c.select("c_custkey", times.clock(F.col("s")).alias("clock"), times.progress(F.col("c_custkey") % 7, F.col("c_custkey")).alias("progress"))


from tallyframe.plans import history, inventory, scans  # noqa: E402,F401  they register more queries
