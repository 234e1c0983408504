"""The domain's tables from the star schema and text tables, as DataFrames and as the SQL that says the same.

Every view here has a twin in VIEWS_SQL under the same name; the queries are compared on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and providers that rows take in turn.
EXTENSIONS = (".py", ".txt", ".MD", ".jpg", ".Mp4", ".bin", ".json", ".pdf", "", ".tar.gz", ".html", ".zzz")
PROVIDERS = ("server", "gdrive", "dropbox", "onedrive")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turn(key, values):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _pad(key):
    return F.lpad(key.cast("string"), 9, "0")


def file_instance(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id is not null")
    k = F.col("doc_id")
    return d.select(
        k.alias("ord"),
        F.concat(F.lit("i"), _pad(k)).alias("instance_id"),
        F.when(k % 11 == 0, F.concat(F.lit("c"), _pad(k))).alias("canonical_id"),
        F.lit(None).cast("string").alias("version_id"),
        F.concat(F.lit("s"), _pad(k)).alias("source_id"),
        _turn(k, PROVIDERS).alias("provider"),
        F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), F.when(k % 9 == 0, F.lit("/.Cache/")).when(k % 13 == 0, F.lit("/Windows/")).otherwise(F.lit("/")), F.coalesce("lang", F.lit("xx")), k.cast("string"), _turn(k, EXTENSIONS)).alias("path"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        F.concat(F.lit("text/"), F.coalesce("lang", F.lit("xx"))).alias("mime_type"),
        F.concat(F.lit("2026-01-0"), (k % 9 + 1).cast("string"), F.lit("T00:00:00+00:00")).alias("modified_at"),
        F.lit("2026-01-01T00:00:00+00:00").alias("discovered_at"),
        F.when(k % 17 == 3, F.lit("2026-02-01T00:00:00+00:00")).alias("deleted_at"),
        F.when(k % 3 > 0, F.concat(F.lit("d"), (k % 5).cast("string"))).alias("device_id"),
    )


def previous_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_instance(spark, sf_dir).where("ord % 10 <> 9")


def current_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.col("ord") % 7 == 0
    rows = file_instance(spark, sf_dir).where("ord % 10 <> 8")
    return rows.withColumn("path", F.when(moved, F.concat(F.lit("/archive"), "path")).otherwise(F.col("path"))).withColumn("content_hash", F.when(F.col("ord") % 19 == 5, F.sha2("content_hash", 256)).otherwise(F.col("content_hash")))


def delta_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "purchase", "modified").when(F.col("event_type") == "view", "moved").when(F.col("event_type") == "click", "renamed").otherwise("deleted")
    some = k % 8 != 0
    return e.select(
        k.alias("ord"),
        _turn(u, PROVIDERS).alias("provider_id"),
        kind.alias("event_type"),
        F.concat(F.lit("s"), _pad(u)).alias("source_id"),
        F.concat(F.lit("/delta/"), k.cast("string")).alias("path"),
        F.when(some, F.sha2(k.cast("string"), 256)).alias("content_hash"),
        F.when(some, k % 1000).alias("size"),
        F.when(some, "text/plain").alias("mime_type"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("2026-03-0"), (k % 9 + 1).cast("string"), F.lit("T00:00:00+00:00"))).alias("modified_at"),
        F.lit(None).cast("string").alias("previous_path"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "dx").alias("device_id"),
    )


def file_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("ord"),
        F.concat(F.lit("v"), _pad(k)).alias("version_id"),
        F.concat(F.lit("c"), _pad(F.col("o_custkey"))).alias("canonical_id"),
        F.lit(None).cast("string").alias("parent_version_id"),
        F.sha2(k.cast("string"), 256).alias("content_hash"),
        (k % 4096).alias("size"),
        _turn(k, PROVIDERS).alias("provider"),
        F.concat(F.lit("/orders/"), k.cast("string")).alias("path"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
    )


def audit_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chains are built from: the events of each user in order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.concat(F.lit("u"), _pad(F.col("user_id"))).alias("session_id"),
        F.row_number().over(order).cast("long").alias("seq"),
        F.concat(F.lit("t"), _pad(k)).alias("timestamp_uuid7"),
        F.sha2(F.col("event_type"), 256).alias("content_hash"),
        F.concat(F.lit("f"), _pad(k)).alias("frame_id"),
    )


def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("p"), _pad(k)).alias("provider_id"),
        F.when(k % 3 == 0, F.concat(F.lit("cur"), k.cast("string"))).when(k % 3 == 1, "").alias("cursor"),
        F.when(F.col("c_acctbal") < 0, F.lit("balance below zero")).alias("last_error"),
        (k % 4).cast("int").alias("retries"),
    )


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 by 8 grey images for the three perceptual hashes."""
    from tallyframe.functions import perceptual as P

    e = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    # bounded before it is an integer, which huge and non-finite components are not; NaN counts as the largest
    pixel = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + 1) * 127.5))).cast("int"))
    rows = e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), pixel.alias("px"))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice("px", y * 8 + 1, 8))
    k = F.col("vec_id")
    rows = rows.withColumn("m", matrix)
    return rows.select(
        k.alias("ord"), F.concat(F.lit("f"), _pad(k)).alias("file_id"), F.concat(F.lit("c"), _pad(k)).alias("canonical_file_id"), P.ahash(F.col("m")).alias("a_hash"), P.dhash(F.col("m")).alias("d_hash"), P.phash(F.col("m")).alias("p_hash"), "embedding"
    )


def message(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return c.select(
        F.concat_ws("-", conv, turn).alias("message_id"),
        F.lit("local").alias("source_platform"),
        F.lit("w0").alias("source_workspace"),
        conv.alias("source_channel"),
        (F.col("turn") % 7).cast("string").alias("source_message_id"),
        F.col("role"),
        F.col("text").alias("body_text"),
        F.col("turn").alias("ingested_at"),
    )


def manifest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as manifest records; some lack keys and some come twice."""
    from tallyframe.functions.classify import category, mime_type, shortcut_allowed

    i = file_instance(spark, sf_dir)
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    page = p.select((k + 10**9).alias("ord"), F.concat(F.lit("p"), _pad(k)).alias("uuid7"), F.coalesce("url", F.lit("")).alias("path"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("blake3"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    doc = i.select("ord", F.concat(F.lit("d"), _pad(F.col("ord") - F.col("ord") % 20 % 2)).alias("uuid7"), "path", F.col("content_hash").alias("blake3"), "size")
    rows = doc.unionByName(page).withColumn("path", F.when(F.col("ord") % 23 == 4, None).otherwise(F.col("path"))).withColumn("blake3", F.when(F.col("ord") % 29 == 6, None).otherwise(F.col("blake3")))
    typed = rows.withColumn("mime_type", mime_type(F.coalesce("path", F.lit(""))))
    named = typed.withColumn("category", category(F.coalesce("path", F.lit("")), F.col("mime_type")))
    return named.withColumn("shortcut_allowed", shortcut_allowed(F.col("category")))


# ---- the same in SQL


def _turn_sql(key: str, values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({key} % {len(values)} + 1)::int]"


def _pad_sql(key: str) -> str:
    return f"lpad(({key})::varchar, 9, '0')"


def _mime_sql() -> str:
    """For the suffixes that occur."""
    from mimetypes import MimeTypes

    known = MimeTypes().types_map[True]
    keys = sorted({e.lower() for e in EXTENSIONS if e and not e.endswith(".gz")} | {".tar", ".htm", ".php", ".asp", ".com", ".org", ".net", ".xml"})
    cases = " ".join(f"when '{k}' then '{known[k]}'" for k in keys if k in known)
    return f"case case when sfx = '.gz' then inner_sfx else sfx end {cases} else 'application/octet-stream' end"


VIEWS_SQL = {
    "file_instance": f"""select doc_id as ord, 'i' || {_pad_sql('doc_id')} as instance_id, case when doc_id % 11 = 0 then 'c' || {_pad_sql('doc_id')} end as canonical_id, null::varchar as version_id,
      's' || {_pad_sql('doc_id')} as source_id, {_turn_sql('doc_id', PROVIDERS)} as provider,
      '/' || coalesce(source, 'none') || case when doc_id % 9 = 0 then '/.Cache/' when doc_id % 13 = 0 then '/Windows/' else '/' end || coalesce(lang, 'xx') || doc_id || {_turn_sql('doc_id', EXTENSIONS)} as path,
      sha256(coalesce(text, '')) as content_hash, strlen(coalesce(text, ''))::bigint as size, 'text/' || coalesce(lang, 'xx') as mime_type, '2026-01-0' || (doc_id % 9 + 1) || 'T00:00:00+00:00' as modified_at,
      '2026-01-01T00:00:00+00:00' as discovered_at, case when doc_id % 17 = 3 then '2026-02-01T00:00:00+00:00' end as deleted_at, case when doc_id % 3 > 0 then 'd' || (doc_id % 5) end as device_id
      from documents where doc_id is not null""",
    "previous_snapshot": "select * from file_instance where ord % 10 <> 9",
    "current_snapshot": "select * replace (case when ord % 7 = 0 then '/archive' || path else path end as path, case when ord % 19 = 5 then sha256(content_hash) else content_hash end as content_hash) from file_instance where ord % 10 <> 8",
    "delta_event": f"""select event_id as ord, {_turn_sql('user_id', PROVIDERS)} as provider_id, case event_type when 'signup' then 'new' when 'purchase' then 'modified' when 'view' then 'moved' when 'click' then 'renamed' else 'deleted' end as event_type,
      's' || {_pad_sql('user_id')} as source_id, '/delta/' || event_id as path, case when event_id % 8 <> 0 then sha256(event_id::varchar) end as content_hash, case when event_id % 8 <> 0 then event_id % 1000 end as size,
      case when event_id % 8 <> 0 then 'text/plain' end as mime_type, case when event_id % 4 = 0 then '' else '2026-03-0' || (event_id % 9 + 1) || 'T00:00:00+00:00' end as modified_at,
      case when event_id % 3 = 0 then '' when event_id % 3 = 1 then 'dx' end as device_id from events""",
    "file_version": f"""select o_orderkey as ord, 'v' || {_pad_sql('o_orderkey')} as version_id, 'c' || {_pad_sql('o_custkey')} as canonical_id, sha256(o_orderkey::varchar) as content_hash, o_orderkey % 4096 as size,
      {_turn_sql('o_orderkey', PROVIDERS)} as provider, '/orders/' || o_orderkey as path, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as created_at from orders""",
    "audit_record": f"""select 'u' || {_pad_sql('user_id')} as session_id, row_number() over (partition by user_id order by ts, event_id) as seq, 't' || {_pad_sql('event_id')} as timestamp_uuid7,
      sha256(event_type) as content_hash, 'f' || {_pad_sql('event_id')} as frame_id from events""",
    "sync_state": f"""select 'p' || {_pad_sql('c_custkey')} as provider_id, case when c_custkey % 3 = 0 then 'cur' || c_custkey when c_custkey % 3 = 1 then '' end as cursor, case when c_acctbal < 0 then 'balance below zero' end as last_error,
      (c_custkey % 4)::int as retries from customer""",
    "pixels": "select vec_id, embedding::double[] as embedding, list_transform(embedding::double[], lambda v: greatest(0, least(255, floor((v + 1) * 127.5)))::int) as px from embeddings where vec_id is not null and embedding is not null",
    "cosines": "select list_transform(range(8), lambda k: list_transform(range(32), lambda x: sqrt(case when k = 0 then 1 else 2 end / 32.0::double) * cos((2 * x + 1) * k * pi() / 64))) as c",
    "frequencies": """select vec_id, list_transform(range(64), lambda i: list_sum(list_transform(range(32), lambda y: across[(y // 4) * 8 + i % 8 + 1] * c[i // 8 + 1][y + 1]))) as freq from (
      select *, list_transform(range(64), lambda i: list_sum(list_transform(range(32), lambda x: px[(i // 8) * 8 + x // 4 + 1] * c[i % 8 + 1][x + 1]))) as across from pixels, cosines)""",
    "fingerprint": f"""select vec_id as ord, 'f' || {_pad_sql('vec_id')} as file_id, 'c' || {_pad_sql('vec_id')} as canonical_file_id, embedding, ab, db, list_transform(freq, lambda v: (v >= list_sort(freq[2:])[32])::int) as pb from (
      select *, list_transform(px, lambda v: (64 * v >= list_sum(px))::int) as ab,
        list_transform(range(64), lambda i: (px[(i // 8) * 8 + greatest(i % 8 - 1, 0) + 1] >= px[(i // 8) * 8 + i % 8 + 1])::int) as db from pixels) join frequencies using (vec_id)""",
    "message": """select conv_id || '-' || turn as message_id, 'local' as source_platform, 'w0' as source_workspace, conv_id::varchar as source_channel, (turn % 7)::varchar as source_message_id, role, text as body_text, turn as ingested_at from conversations""",
}


def with_views(sql: str) -> str:
    """The query with the views that it names, and those that they name, before it."""
    import re

    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS_SQL:
            if re.search(rf"\b{name}\b", text) and name not in used:
                need(VIEWS_SQL[name])
                if name not in used:
                    used.append(name)

    need(sql)
    views = ",\n".join(f"{n} as ({VIEWS_SQL[n]})" for n in used)
    if not views:
        return sql
    head = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    if head:
        return f"with {head[1] or ''}{views},\n{sql[head.end():]}"
    return f"with {views}\n{sql}"
