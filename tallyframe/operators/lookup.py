"""Lookups: z-paths, aliases, any identifier, arrivals of mounts, and small routing rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.paths import provider_hint, z_path_id
from tallyframe.operators.graph import cut

# The rules of lanes, roles and task kinds.
AUTONOMY = {"warp": {"execution": 3, "design": 1}, "cody": {"artifact_generation": 3, "execution": 0}, "copilot": {"coordination": 3, "direct_execution": 0}, "experimental": {"compute": 3, "infrastructure": 0}}
ROUTES = {"warp": (("deploy", "restart", "validate", "sync"), 0.95), "cody": (("design", "patch", "document", "plan"), 0.92), "copilot": (("route", "coordinate", "approve", "triage"), 0.93)}
READ_ROLES, WRITE_ROLES = ("scan", "resolve", "inspect", "sync"), ("ingest", "canonicalize", "shortcuts")


def resolve_z_paths(paths: DataFrame, files: DataFrame, column: str = "z_path") -> DataFrame:
    """paths with uuid7, path and error: not a z-path, no id, or an unknown id."""
    rows = paths.withColumn("uuid7", z_path_id(F.col(column)))
    known = files.select(F.col("uuid7").alias("_id"), F.col("path"))
    found = rows.join(known, F.col("uuid7") == F.col("_id"), "left").drop("_id")
    error = F.when(~F.coalesce(F.col(column).startswith("z://"), F.lit(False)), "z path must start with z://").when(F.col("uuid7").isNull(), "z path missing uuid7 value").when(F.col("path").isNull(), F.concat(F.lit("unknown uuid7: "), "uuid7"))
    return found.withColumn("error", error)


def find_any(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (uuid7, hash, path) with the file found by id, else by digest, else by path; the first by id of several."""
    out = cut(wanted.withColumn("_w", F.monotonically_increasing_id()))  # the numbers have to be the same each time they are used
    found = []
    for rank, (key, other) in enumerate((("uuid7", "uuid7"), ("hash", "blake3"), ("path", "path"))):
        side = files.select(F.col(other).alias("_k"), F.col("uuid7").alias("found_uuid7"), F.col("path").alias("found_path"))
        found.append(out.select("_w", F.col(key).alias("_k")).join(side, "_k").select("_w", F.struct(F.lit(rank).alias("rank"), "found_uuid7", "found_path").alias("f")))
    best = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("_w").agg(F.min("f").alias("f"))
    named = F.coalesce("uuid7", "hash", "path").isNotNull()
    return out.join(best, "_w", "left").select(*wanted.columns, F.col("f.found_uuid7").alias("found_uuid7"), F.col("f.found_path").alias("found_path"), F.when(~named, "no identifier given").alias("error"))


def resolve_aliases(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (name) with entity_id, by any of an entity's aliases, whatever the case."""
    alias = entities.select("entity_id", F.explode("aliases").alias("a")).groupBy(F.lower("a").alias("_a")).agg(F.min("entity_id").alias("entity_id"))
    return names.join(alias, F.lower("name") == F.col("_a"), "left").drop("_a")


def new_mounts(previous: DataFrame, current: DataFrame, platform: str = "linux") -> DataFrame:
    """(platform, mount_path, provider_hint) of mounts (mount_path) that have arrived. On wsl only those below /mnt."""
    if platform not in ("linux", "windows", "wsl"):
        raise ValueError(platform)
    new = current.select("mount_path").subtract(previous.select("mount_path"))
    hint = {"linux": provider_hint(F.col("mount_path")), "windows": F.lit(None).cast("string"), "wsl": F.lit("wsl")}[platform]
    if platform == "wsl":
        new = new.where(F.col("mount_path").startswith("/mnt/"))
    return new.select(F.lit(platform).alias("platform"), "mount_path", hint.alias("provider_hint"))


def autonomy_score(lane: Column, role: Column) -> Column:
    """By lane and role; an unknown lane counts as experimental, an unknown role scores 0."""
    known = F.when(lane.isin(*AUTONOMY), lane).otherwise("experimental")
    score = F.lit(0)
    for name, roles in AUTONOMY.items():
        for r, value in roles.items():
            score = F.when((known == name) & (role == r), value).otherwise(score)
    return score


def lane_gate(lane: Column, destructive: Column, requires: Column, authorized: Column) -> Column:
    no = lambda c, default: F.coalesce(c, F.lit(default))
    return F.when(no(destructive, False) & (lane != "warp"), "destructive action requires Warp lane and Copilot authorization").when(no(requires, True) & ~no(authorized, False), "operation is not authorized").otherwise("operation passed lane gate")


def route(kind: Column) -> Column:
    """(lane, confidence) for a kind of task."""
    out = F.struct(F.lit("experimental").alias("lane"), F.lit(0.7).alias("confidence"))
    for lane, (kinds, confidence) in ROUTES.items():
        out = F.when(F.lower(kind).isin(*kinds), F.struct(F.lit(lane).alias("lane"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def escalation_target(lane: Column) -> Column:
    return F.when(lane.isin("warp", "cody", "experimental"), "copilot").otherwise("operator")


def permissions(role: Column) -> Column:
    return F.struct(role.isin(*READ_ROLES, *WRITE_ROLES).alias("may_read"), role.isin(*WRITE_ROLES).alias("may_write"), (role == "canonicalize").alias("may_touch_canonical_store"))


def best_worker(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """jobs (job_id, lane_hint) with the worker of that lane that scores highest, the earliest registered among equals."""
    best = workers.groupBy("lane").agg(F.max_by("worker_id", F.struct("score", -F.col("ord"))).alias("worker_id"))
    return jobs.join(best, F.col("lane_hint") == F.col("lane"), "left").drop("lane")
