"""Digests. The algorithm is always named beside its result, and never exchanged silently."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _hasher(algorithm: str) -> Callable[[bytes], str]:
    if algorithm == "blake2b":
        return lambda b: hashlib.blake2b(b, digest_size=32).hexdigest()
    if algorithm == "blake2b-16":
        return lambda b: hashlib.blake2b(b, digest_size=16).hexdigest()
    if algorithm == "blake3":
        import blake3  # an optional wheel; asking for it without it is an error

        return lambda b: blake3.blake3(b).hexdigest()
    raise ValueError(f"unknown digest {algorithm}")


def digest(payload: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hex of a binary or string column. sha256 stays in the JVM, the others are Arrow functions."""
    if algorithm == "sha256":
        return F.sha2(payload, 256)
    name = algorithm
    _hasher(name)  # an unknown one is an error here, not in a task

    @F.pandas_udf("string")
    def of(parts: pd.Series) -> pd.Series:
        h = _hasher(name)
        return parts.map(lambda b: None if b is None else h(bytes(b)))

    return of(payload.cast("binary"))


def dual_digest(payload: Column, algorithm: str = "blake2b") -> Column:
    """Two digests of one payload, and the name of the first's algorithm."""
    return F.struct(F.lit(algorithm).alias("algorithm"), digest(payload, algorithm).alias("digest"), digest(payload).alias("sha256"))


def metadata_digest(**fields: Column) -> Column:
    """The digest that stands in for content that can't be read: sorted compact JSON of the fields, nulls kept."""
    return F.struct(F.lit("fallback").alias("algorithm"), digest(canonical_json(**fields)).alias("digest"))


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys, without spaces, with nulls."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"})


def quick_hash(path: Column, size: Column, mtime: Column) -> Column:
    return digest(F.concat(path, size.cast("string"), mtime.cast("string")), "blake2b-16")


def source_id(provider: Column, root: Column, device: Column, label: Column) -> Column:
    return digest(canonical_json(provider=provider, root=root, device_uuid=device, label=label))


def cloud_root_id(provider: Column, root: Column) -> Column:
    return digest(canonical_json(provider=provider, root=root, kind=F.lit("cloud-root")))
