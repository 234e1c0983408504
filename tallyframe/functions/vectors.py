"""Vectors as array<double> columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Clamped to [-1, 1]; 0 if either is zero; an error if lengths differ. Norms may be given."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    value = F.when((na == 0) | (nb == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), na * nb))))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("embedding dimensions must match")).cast("double"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex texts of equal length, 8 digits at a time; an error if lengths differ."""
    part = lambda c, i: F.conv(F.substring(c, i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    bits = F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.char_length(a) - 1) / 8)).cast("int")), F.lit(0), lambda s, i: s + F.coalesce(F.bit_count(part(a, i).bitwiseXOR(part(b, i))), F.lit(0)))
    return F.when(F.char_length(a) == F.char_length(b), F.when(F.char_length(a) == 0, 0).otherwise(bits)).otherwise(F.raise_error(F.lit("hash lengths must match")).cast("int"))


def perceptual_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """1 - differing bits / (hashes * bits), clamped to [0, 1]. Keys name the hashes, of one length each."""
    wrong = sum((hamming(a[k], b[k]) for k in a), F.lit(0))
    bits = F.greatest(*(F.char_length(c) for c in a.values()), F.lit(0)) * 4
    return F.when(bits == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - wrong / F.nullif(bits * float(len(a)), F.lit(0.0)))))


def combined(cos: Column, perceptual: Column) -> Column:
    return 0.7 * cos + 0.3 * perceptual


def mean_unit(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, embedding): the element-wise mean of each key's vectors, made a unit vector; a zero mean stays zero.
    Positions are averaged apart, so that a key's vectors never meet in one row."""
    mean = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("x"))
    whole = mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("m"))
    n = norm(F.col("m"))
    return whole.select(key, F.when(n == 0, F.col("m")).otherwise(F.transform("m", lambda x: x / n)).alias("embedding"))


class EmbeddingModel(Protocol):
    def encode(self, payload: bytes, mime_type: str | None = None) -> Sequence[float]:
        """A unit vector for a payload."""


class ByteHistogram:
    """Byte values counted in bins, as a unit vector; zeros for an empty payload."""

    def __init__(self, bins: int = 64):
        if bins <= 0:
            raise ValueError("bins must be positive")
        self.bins = bins
        self.place = np.minimum(np.arange(256) * bins // 256, bins - 1)

    def encode(self, payload: bytes, mime_type: str | None = None) -> np.ndarray:
        h = np.bincount(self.place[np.frombuffer(payload, np.uint8)], minlength=self.bins).astype(float)
        n = np.sqrt((h * h).sum())
        return h / n if n else h


def encode(payload: Column, mime_type: Column, model: EmbeddingModel) -> Column:
    """The model's vector of each payload; null for a null payload. The model goes to the workers once for a partition."""

    @F.pandas_udf("array<double>")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, kinds in parts:
            yield pd.Series([None if b is None else np.asarray(model.encode(bytes(b), k), float) for b, k in zip(bodies, kinds, strict=True)], dtype=object)

    return of(payload.cast("binary"), mime_type)


def byte_histogram(payload: Column, bins: int = 64) -> Column:
    """Byte values counted in bins, as a unit vector; zeros for an empty payload."""
    return encode(payload, F.lit(None).cast("string"), ByteHistogram(bins))
