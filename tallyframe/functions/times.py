"""Times, durations and sizes for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_time(text: Column) -> Column:
    """An ISO-8601 text, Z included, as a timestamp; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def elapsed(start: Column, now: Column | None = None) -> Column:
    """Seconds from a start to now, never below zero."""
    end = F.current_timestamp() if now is None else now
    return F.greatest(F.lit(0.0), (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6)


def progress(part: Column, whole: Column) -> Column:
    """Percent to two decimals; 100 of nothing."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.bround(part.cast("double") / F.nullif(whole, F.lit(0)) * 100.0, 2))


def clock(seconds: Column) -> Column:
    """h:mm:ss; a dash for null or negative."""
    s = F.floor(seconds).cast("long")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(seconds.isNull() | (seconds < 0), "–").otherwise(F.concat_ws(":", F.floor(s / 3600).cast("string"), pad(F.floor(s % 3600 / 60)), pad(s % 60)))


def bytes_text(size: Column) -> Column:
    """1.5 MB and the like, by powers of 1024."""
    out = F.concat(F.format_string("%.0f", size.cast("double")), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", size / F.lit(float(1024**k))), F.lit(f" {unit}"))).otherwise(out)
    return out
