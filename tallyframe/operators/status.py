"""Counts, progress and checks of a scan and ingestion run. A run's state is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.times import elapsed, iso_time, progress

# What a stage is called and what it waits for.
DESCRIPTIONS = {1: "Sampling filesystem…", 2: "Building manifest…", 3: "Hashing files…"}
NEXT = {1: "Waiting for Stage 1 sample…", 2: "Waiting for Stage 2 manifest…", 3: "Waiting for Stage 3 results…"}
STATE = (
    "current_stage int, stage1_files_processed long, stage2_files_processed long, stage3_files_processed long, stage1_files_total long, stage2_files_total long, "
    "stage1_complete boolean, stage2_complete boolean, stage3_complete boolean, stage1_started_at string, stage2_started_at string, stage3_started_at string"
)


def category_counts(files: DataFrame) -> DataFrame:
    """Most frequent first, by name among equals."""
    return files.groupBy("category").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category")


def manifest_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("total"), F.count_if(F.lower("category") == "canonical").alias("canonical_count"), F.count_if(F.coalesce("shortcut_allowed", F.lit(False))).alias("shortcut_count"))


def _first_positive(*names: str) -> Column:
    """The first of the columns that is neither null nor 0, else 0."""
    return F.coalesce(*(F.nullif(F.col(n).cast("long"), F.lit(0).cast("long")) for n in names), F.lit(0).cast("long"))


def pipeline_status(state: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """One row of counts and progress from the state, the manifest's records and the indexed files."""
    one = state.join(manifest_counts(records), F.lit(True)).join(files.agg(F.count("*").alias("db_indexed_count")), F.lit(True))
    counts = one.select(
        _first_positive("stage2_files_total", "stage1_files_total", "total").alias("filesystem_count"),
        *(F.coalesce(f"stage{k}_files_processed", F.lit(0)).cast("long").alias(f"stage{k}_count") for k in (1, 2, 3)),
        "db_indexed_count", "canonical_count", "shortcut_count",
    )
    c = F.col
    return counts.select(
        "*",
        progress(c("stage2_count"), c("filesystem_count")).alias("scanner_progress"),
        progress(c("db_indexed_count"), c("stage2_count")).alias("processed_progress"),
        progress(c("db_indexed_count"), c("filesystem_count")).alias("ingestion_progress"),
    )


def live_status(state: DataFrame, sample_there: bool, index_there: bool, last_log: str = "", now: Column | None = None) -> DataFrame:
    """One row telling what a run is doing. An empty state is a run that has not begun."""
    done = [F.coalesce(F.col(f"stage{k}_complete"), F.lit(False)) for k in (1, 2, 3)]
    one = state.sparkSession.range(1).drop("id").join(state.withColumn("_there", F.lit(True)), F.lit(True), "left")
    begun = F.coalesce("_there", F.lit(False))
    stage = F.coalesce(F.nullif("current_stage", F.lit(0)), F.when(~done[0], 1).when(~done[1], 2).when(~done[2], 3).otherwise(0)).cast("int")
    crawl = (F.col("current_stage") == 1) & F.lit(not sample_there)
    pick = lambda table, other: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("current_stage")), F.lit(other))
    started = F.when(F.col("current_stage") == 1, F.col("stage1_started_at")).when(F.col("current_stage") == 2, F.col("stage2_started_at")).when(F.col("current_stage") == 3, F.col("stage3_started_at"))
    rows = one.withColumn("current_stage", stage)
    return rows.select(
        "current_stage",
        F.when(crawl, "Crawling filesystem…").otherwise(pick(DESCRIPTIONS, "Idle")).alias("stage_description"),
        F.bround(F.coalesce(elapsed(iso_time(started), now), F.lit(0.0)), 2).alias("stage_elapsed_seconds"),
        (begun & ~(done[0] & done[1] & done[2])).alias("pipeline_active"),
        F.when((F.col("current_stage") == 1) & F.lit(sample_there), NEXT[2]).otherwise(pick(NEXT, "Pipeline complete")).alias("next_expected_event"),
        F.lit(last_log).alias("last_log_line"),
        _first_positive("stage2_files_total", "stage1_files_total").alias("filesystem_count"),
        *(F.coalesce(f"stage{k}_files_processed", F.lit(0)).cast("long").alias(f"stage{k}_count") for k in (1, 2, 3)),
        crawl.alias("crawl_phase"),
        F.when(crawl, "indeterminate").when(F.lit(sample_there or index_there), "available").otherwise("pending").alias("crawl_progress"),
        F.when(crawl, "Filesystem crawl in progress…").otherwise("").alias("crawl_message"),
    )


def check(name: str, ok: Column, rows: DataFrame, detail: Column | None = None) -> DataFrame:
    """One row (check, passed, detail) from an aggregate over rows."""
    return rows.agg(F.coalesce(ok, F.lit(False)).alias("passed"), (F.lit("") if detail is None else detail.cast("string")).alias("detail")).select(F.lit(name).alias("check"), "passed", "detail")


def report(*checks: DataFrame) -> DataFrame:
    """The checks under one another, each with whether all passed."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    return rows.join(rows.agg(F.bool_and("passed").alias("all_passed")), F.lit(True))


def verification(state: DataFrame, records: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("uuid7", "path", "source", "size", "blake3", "category")) -> DataFrame:
    """Whether a run's stages are complete and its manifest and tables agree."""
    n = F.count("*")
    return report(
        *(check(f"stage{k}_complete", F.bool_and(F.coalesce(f"stage{k}_complete", F.lit(False))), state) for k in (1, 2, 3)),
        check("manifest_not_empty", n > 0, records, n),
        check("manifest_record_keys", F.bool_and(F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)), records),
        check("manifest_paths_distinct", n == F.count_distinct("path"), records, F.count_distinct("path")),
        check("files_indexed", n > 0, files, n),
        check("files_have_category", F.bool_and(F.col("category").isNotNull()), files),
    )


def run_errors(error_log: DataFrame, most: int = 100) -> DataFrame:
    """The last errors, oldest first."""
    return error_log.orderBy(F.desc("ord")).limit(most).orderBy("ord")


def run_summary(indexed: DataFrame, digests: DataFrame) -> DataFrame:
    """One row on a staged scan, from its index (path, size, mtime) and its digests (path, size, digest, error): files and bytes indexed, files with a digest and without, the bytes that
    copies take beyond the first, and when the newest file was changed."""
    whole = indexed.agg(F.count("*").alias("files_total"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_total"), F.max("mtime").alias("newest_mtime"))
    copies = digests.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    unique = copies.agg(F.count("*").alias("distinct_digests"), F.coalesce(F.sum("n"), F.lit(0)).alias("files_digested"), F.coalesce(F.sum((F.col("n") - 1) * F.col("size")), F.lit(0)).alias("bytes_in_copies"))
    failed = digests.agg(F.count("error").alias("files_failed"))
    return whole.join(F.broadcast(unique)).join(F.broadcast(failed))  # a row each


def readiness(state: DataFrame, log: DataFrame, index_there: bool, tables: dict[str, DataFrame]) -> DataFrame:
    """(check, passed, detail, all_passed): whether stage 2 is logged as complete, stage 3 can run or has begun, and the tables hold rows.
    log: (ord, line). The last line that says so counts."""
    found = F.regexp_extract("line", r"(?i)stage\s*2\s*complete:\s*([0-9]+)", 1)
    second = log.where(found != "").agg(F.max_by(found, "ord").alias("n"))
    two = second.select(F.lit("stage2").alias("check"), F.col("n").isNotNull().alias("passed"), F.coalesce(F.concat(F.lit("complete: "), "n", F.lit(" files indexed")), F.lit("no completion in the log")).alias("detail"))
    done = lambda k: F.coalesce(F.bool_and(F.coalesce(f"stage{k}_complete", F.lit(False))), F.lit(False))
    begun = F.coalesce(F.bool_or(F.col("stage3_started_at").isNotNull() | (F.coalesce("stage3_files_processed", F.lit(0)) > 0)), F.lit(False))
    three = state.agg(done(2).alias("ready"), (begun | done(3)).alias("begun")).select(
        F.lit("stage3").alias("check"),
        (F.col("ready") & F.lit(index_there)).alias("passed"),
        F.when(~F.col("ready"), "stage 2 is not complete").when(~F.lit(index_there), "the index of stage 2 is missing").when(F.col("begun"), "has started or is complete").otherwise("ready").alias("detail"),
    )
    sizes = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    listed = F.array_sort(F.collect_list(F.struct(F.expr("array_position(array({}), name)".format(", ".join(f"'{n}'" for n in tables))).alias("k"), "name", "n")))
    if sizes is None:
        return report(two, three)
    text = lambda keep, show: F.array_join(F.transform(F.filter("t", keep), show), " ")
    full, empty = text(lambda x: x["n"] > 0, lambda x: F.concat(x["name"], F.lit("="), x["n"])), text(lambda x: x["n"] == 0, lambda x: x["name"])
    base = sizes.agg(listed.alias("t")).select(F.lit("database").alias("check"), F.forall("t", lambda x: x["n"] > 0).alias("passed"), F.concat(full, F.when(empty != "", F.concat(F.lit(" empty: "), empty)).otherwise("")).alias("detail"))
    return report(two, three, base)
