"""The canonical store: one copy of each digest's content, under its digest, and shortcuts to it."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.paths import canonical_path


def plan(files: DataFrame, root: str, algorithm: str = "sha256") -> DataFrame:
    """files (path, digest) with canonical_path and whether the row is the one whose content is copied: the first path of its digest. A digest may be that of very many files, such as empty
    ones: its first path is found by a partial aggregate, and the join has one row for each digest on one side."""
    first = files.groupBy("digest").agg(F.min("path").alias("_first"))
    rows = files.withColumn("canonical_path", canonical_path(root, F.col("digest"), algorithm)).join(first.withColumnRenamed("digest", "_digest"), F.col("digest").eqNullSafe(F.col("_digest")))
    return rows.withColumn("copied", F.col("path") == F.col("_first")).drop("_first", "_digest")


def _sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            h.update(chunk)
    return h.hexdigest()


def materialize(planned: DataFrame, shortcuts: bool = False) -> DataFrame:
    """Carries the plan out and says what became of each file: (path, canonical_path, status). A copy is checked against its digest
    before it gets its name, so that an attempt that is repeated or lost leaves nothing half done. root must be a folder
    that all executors share. Files whose content has another digest are errors. Lazy: nothing happens until it is used."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                try:
                    if r.copied and not os.path.exists(r.canonical_path):
                        os.makedirs(os.path.dirname(r.canonical_path), exist_ok=True)
                        fd, part = tempfile.mkstemp(dir=os.path.dirname(r.canonical_path))
                        os.close(fd)
                        shutil.copyfile(r.path, part)
                        if _sha256(part) != r.digest:
                            os.unlink(part)
                            raise ValueError("content differs from its digest")
                        os.replace(part, r.canonical_path)
                    link = f"{r.path}.link"
                    if shortcuts and not os.path.lexists(link):
                        os.symlink(r.canonical_path, link)
                    status = "ok"
                except (OSError, ValueError) as e:
                    status = str(e)
                out.append((r.path, r.canonical_path, status))
            yield pd.DataFrame(out, columns=["path", "canonical_path", "status"])

    return planned.select("path", "digest", "canonical_path", "copied").mapInPandas(run, "path string, canonical_path string, status string")


def call_hook(records: DataFrame, hook: Callable[[dict], object], isolate: bool = True) -> DataFrame:
    """records with error: the hook (a function or a coroutine function) is called with each as a dict, in the tasks. isolate: what it raises is
    kept as the record's error, else it ends the run. A task that is repeated calls it again, so it has to bear that."""
    import asyncio
    import inspect

    schema = T.StructType([*records.schema.fields, T.StructField("error", T.StringType())])

    def one(record: dict) -> str | None:
        try:
            out = hook(record)
            if inspect.isawaitable(out):

                async def wait() -> object:
                    return await out

                asyncio.run(wait())
        except Exception as e:  # noqa: BLE001  whatever a hook raises is its record's error
            if not isolate:
                raise
            return f"{type(e).__name__}: {e}"
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            errors = pa.array([one(r) for r in rows.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, errors], names=[*rows.schema.names, "error"])

    return records.mapInArrow(run, schema)
