"""Directory trees as rows: a data source that lists regular files, dotfiles included, and digests them on request.

spark.read.format("file_walk").option("root", ...) with the options excludedDirs (names, comma-separated, any case), excludedPrefixes (paths,
comma-separated), digest (none, or an algorithm: content is then read once, in chunks, for it and SHA-256) and errors
(true adds the files and folders that could not be read). Directories are split level by level until there are PARTS partitions or none is left
to split, so that a tree with one directory at its top is not one task.
"""

from __future__ import annotations

import hashlib
import importlib.util
import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Directories that scans leave out, by kind of scan.
ALWAYS_EXCLUDED = ("containerd", "docker", "lost+found")
LOCAL_EXCLUDED = ("containerd", "docker", "lost+found", "cache", "caches", "temp", "tmp", "android")
WINDOWS_EXCLUDED = ("$recycle.bin", "program files", "program files (x86)", "programdata", "system volume information", "windows")
CHUNK = 1 << 20
#: Partitions that a tree should have; the directories that are listed to get there are no more than that and their siblings.
PARTS = 64
SCHEMA = "path string, name string, size long, mtime double, mode int, is_symlink boolean, hash_algorithm string, digest string, sha256 string, error string"


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


def hasher(algorithm: str):
    """A new hash object; blake3 needs its wheel, and asking for it without it is an error."""
    if algorithm == "blake3":
        import blake3

        return blake3.blake3()
    return hashlib.sha256() if algorithm == "sha256" else hashlib.blake2b(digest_size=32)


def best_digest() -> str:
    """blake3 where its wheel is installed, else sha256; rows always say which."""
    return "blake3" if importlib.util.find_spec("blake3") else "sha256"


def _digests(path: str, algorithm: str) -> tuple[str, str]:
    """(digest, SHA-256) of a file, read once."""
    first = hasher(algorithm)
    second = first if algorithm == "sha256" else hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            first.update(chunk)
            if second is not first:
                second.update(chunk)
    return first.hexdigest(), second.hexdigest()


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("root") or options.get("path")
        if not self.root:
            raise ValueError("the option root is needed")
        names = lambda key: [x.strip() for x in options.get(key, "").split(",") if x.strip()]
        self.excluded = {n.lower() for n in (*names("excludeddirs"), *ALWAYS_EXCLUDED)}
        self.prefixes = [p.rstrip("/") for p in names("excludedprefixes")]
        self.digest = options.get("digest", "none")
        if self.digest not in ("none", "sha256", "blake2b", "blake3"):
            raise ValueError(f"unknown digest {self.digest}")
        if self.digest == "blake3":
            hasher("blake3")
        self.errors = options.get("errors", "false").lower() == "true"

    def _left_out(self, path: str) -> bool:
        return any(path == p or path.startswith(p + "/") for p in self.prefixes)

    def _kept(self, folder: str, names: list[str]) -> list[str]:
        return sorted(n for n in names if n.lower() not in self.excluded and not self._left_out(os.path.join(folder, n)))

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)
        shallow, deep = [], [self.root]
        while deep and len(shallow) + len(deep) < PARTS:
            inner = []
            for folder in deep:
                try:
                    with os.scandir(folder) as entries:
                        names = [e.name for e in entries if e.is_dir(follow_symlinks=False)]
                    shallow.append(_Part(folder, False))
                    inner += [os.path.join(folder, n) for n in self._kept(folder, names)]
                except OSError:
                    shallow.append(_Part(folder, True))  # the task that reads it says what is wrong
            deep = inner
        return shallow + [_Part(folder, True) for folder in deep]

    def _row(self, path: str, name: str, error: OSError) -> tuple:
        return (path, name, None, None, None, None, None, None, None, str(error))

    def _folders(self, partition: _Part, failed: list[OSError]) -> Iterator[tuple[str, Iterator[str]]]:
        """Folders from the top down, each with the names of what is no folder in it, which are not held: a folder may have very many."""
        todo = [partition.folder]
        while todo:
            folder, inner = todo.pop(), []

            def names(folder: str = folder, inner: list[str] = inner) -> Iterator[str]:
                try:
                    with os.scandir(folder) as entries:
                        for e in entries:
                            try:
                                is_dir = e.is_dir()
                            except OSError:
                                is_dir = False
                            if not is_dir:
                                yield e.name
                            elif partition.deep and not e.is_symlink():
                                inner.append(e.name)
                except OSError as e:
                    failed.append(e)

            yield folder, names()
            todo += [os.path.join(folder, n) for n in reversed(self._kept(folder, inner))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        failed: list[OSError] = []
        for folder, files in self._folders(partition, failed):
            for name in files:
                path = os.path.join(folder, name)
                try:
                    s = os.stat(path)
                    if not stat.S_ISREG(s.st_mode) or self._left_out(path):
                        continue
                    both = _digests(path, self.digest) if self.digest != "none" else (None, None)
                    yield (path, name, s.st_size, s.st_mtime, s.st_mode, os.path.islink(path), self.digest if self.digest != "none" else None, *both, None)
                except OSError as e:
                    if self.errors:
                        yield self._row(path, name, e)
        if self.errors:
            for e in failed:
                yield self._row(str(e.filename), os.path.basename(str(e.filename).rstrip("/")), e)


def file_digest(path: Column) -> Column:
    """(digest, error): the SHA-256 of the file at a path, or why it can't be read."""

    @F.pandas_udf("digest string, error string")
    def of(names: pd.Series) -> pd.DataFrame:
        out = []
        for n in names:
            try:
                out.append((_digests(n, "sha256")[0], None))
            except OSError as e:
                out.append((None, e.strerror))
        return pd.DataFrame(out, columns=["digest", "error"])

    return of(path)


def digested(files: DataFrame) -> DataFrame:
    """(path, digest): the SHA-256 of listed files. A folder is one task's to list, however many files it has; they are dealt out evenly to be read. Files that
    can't be read are left out, as by a walk that digests them itself."""
    tasks = max(200, 4 * files.sparkSession.sparkContext.defaultParallelism)
    return files.select("path").repartition(tasks, "path").withColumn("f", file_digest(F.col("path"))).where("f.error is null").select("path", "f.digest")


class WalkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(self.options)


def walk(spark: SparkSession, root: str, excluded_dirs: tuple[str, ...] = LOCAL_EXCLUDED, excluded_prefixes: tuple[str, ...] = (), digest: str = "none", errors: bool = False) -> DataFrame:
    spark.dataSource.register(WalkSource)
    options = {"root": root, "excludedDirs": ",".join(excluded_dirs), "excludedPrefixes": ",".join(excluded_prefixes), "digest": digest, "errors": str(errors).lower()}
    return spark.read.format("file_walk").options(**options).load()


def walk_all(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """The files below all roots that exist, each once, also if roots lie in one another."""
    there = [r for r in dict.fromkeys(roots) if os.path.isdir(r)]
    if not there:
        return spark.createDataFrame([], SCHEMA)
    rows = walk(spark, there[0], **options)
    for r in there[1:]:
        rows = rows.unionByName(walk(spark, r, **options))
    return rows if len(there) == 1 else rows.dropDuplicates(["path"])


def count_files(spark: SparkSession, roots: list[str]) -> int:
    """Files below the roots that exist, without reading any."""
    return walk_all(spark, roots).count()


def changed(files: DataFrame, completed: DataFrame) -> DataFrame:
    """Files that are not among the completed (path, mtime) with the same time: what a resumed scan still has to read."""
    return files.join(completed.select("path", "mtime").distinct(), ["path", "mtime"], "left_anti").select(files.columns)
