"""The three-stage scan: a sample, an index of metadata, then digests. Each stage is a table, so that a run that broke off
goes on from the rows that are not there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.merge import Snapshots
from tallyframe.sources.walk import file_digest, walk

# Paths that a scan of a whole system leaves out.
SYSTEM_PREFIXES = (
    "/bin", "/boot", "/dev", "/etc", "/lib", "/lib32", "/lib64", "/proc", "/root", "/run", "/sbin", "/snap", "/sys", "/tmp", "/usr", "/var/lib/systemd",
    "/srv/data/AppData", "/srv/data/docker", "/srv/data/containerd", "/DATA/raid/docker", "/var/log/containers", "/var/log/pods", "/var/lib/kubelet", "/var/lib/docker", "/var/lib/containerd",
)


def prefixes_for(root: str) -> tuple[str, ...]:
    """The prefixes that lie below the root: one that the root itself is in was asked for."""
    at = root.rstrip("/") + "/"
    return tuple(p for p in SYSTEM_PREFIXES if not at.startswith(p + "/"))


def sample(spark: SparkSession, root: str, n: int = 100) -> DataFrame:
    """The first files by path."""
    return walk(spark, root, (), prefixes_for(root)).orderBy("path").limit(n)


def index(spark: SparkSession, root: str, table: Snapshots) -> DataFrame:
    """Adds the files that the index does not have with the same time; the rest of the index stays."""
    files = walk(spark, root, (), prefixes_for(root)).select("path", "size", "mtime", "mode", F.lit(0).cast("long").alias("ord"))
    table.merge(files, ["path"])
    return table.read()


def digest(indexed: DataFrame, table: Snapshots) -> DataFrame:
    """Digests of the indexed files that have none for their time, dealt out evenly; files that have gone become errors."""
    done = table.read()
    todo = indexed if done is None else indexed.join(done.where("error is null").select("path", "mtime"), ["path", "mtime"], "left_anti")
    read = todo.select("path", "size", "mtime").repartition("path").withColumn("f", file_digest(F.col("path")))
    table.merge(read.select("path", "size", "mtime", "f.digest", "f.error", F.lit(0).cast("long").alias("ord")), ["path"])
    return table.read()


def run(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """All stages; run again, it does what is left. Returns the table of digests."""
    first = Snapshots(spark, f"{folder}/sample")
    if first.read() is None:
        first.write(sample(spark, root))
    return digest(index(spark, root, Snapshots(spark, f"{folder}/index")), Snapshots(spark, f"{folder}/digests"))
