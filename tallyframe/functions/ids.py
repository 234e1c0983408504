"""Identifiers: time-ordered ids, their time, and ids that follow from content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _grouped(hex32: Column) -> Column:
    return F.concat_ws("-", *(F.substring(hex32, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def uuid7(seed: int | None = None) -> Column:
    """48 bits of milliseconds, the version, 74 random bits. Not deterministic, so for sinks only."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    random = F.lpad(F.lower(F.hex((F.rand(seed) * F.lit(2.0**52)).cast("long"))), 13, "0")
    more = F.lpad(F.lower(F.hex((F.rand(None if seed is None else seed + 1) * F.lit(2.0**52)).cast("long"))), 13, "0")
    return _grouped(F.concat(ms, F.lit("7"), F.substring(random, 1, 3), F.lpad(F.substring(F.concat(random, more), 4, 15), 16, "0")))


def id_at(ms: Column, natural_key: Column) -> Column:
    """The id for a time and a natural key: the same for the same input, with the form of uuid7."""
    h = F.sha2(natural_key, 256)
    return _grouped(F.concat(F.lpad(F.lower(F.hex(ms)), 12, "0"), F.lit("7"), F.substring(h, 1, 3), F.lit("0"), F.substring(h, 4, 15)))


def id_millis(uuid: Column) -> Column:
    """Milliseconds since the epoch from the id's first 48 bits."""
    return F.conv(F.substring(F.regexp_replace(uuid, "-", ""), 1, 12), 16, 10).cast("long")


def id_time(uuid: Column) -> Column:
    return F.timestamp_millis(id_millis(uuid))


def embed_text(text: Column) -> Column:
    """16 numbers from the first bytes of the text's SHA-256, byte / 255 to six decimals."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.bround(F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0, 6))
