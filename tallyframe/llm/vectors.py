"""What the vector operators share: which vectors take part, and how they travel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def element(df: DataFrame, vector_col: str) -> str:
    """How components travel: as floats if they are floats, else as doubles."""
    kind = df.schema[vector_col].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def packed(vector: Column, dtype: str = "<f8") -> Column:
    """The vector as little-endian numbers; null if it is null, empty, zero or holds null or non-finite components."""

    @F.pandas_udf("binary")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield pd.Series([_pack(v, dtype) for v in vectors], dtype=object)

    return of(vector.cast("array<double>"))


def _pack(v, dtype: str) -> bytes | None:
    if v is None:
        return None
    a = np.asarray(v, dtype) + np.zeros((), dtype)
    return a.tobytes() if a.size and np.isfinite(a).all() and a.any() else None


def unpacked(parts: pd.Series, dtype: str = "<f8") -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return np.frombuffer(b"".join(parts), dtype).reshape(len(parts), -1).astype(np.float64, copy=False)


def units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)
