"""Joins by time: the newest row at or before another, and intervals that overlap; and frames of time behind each row.

No key has to fit one task. Keys with many rows (hot ones, found by a count) are cut into pieces of time with about as many rows each, and what a
piece needs from earlier ones is handed on. Nothing here compares every row with every other.

Cases: rows with a null key or time match nothing; left rows then keep nulls. Equal rows each count. Columns with clashing names: what is
taken from the right side is a struct of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.graph import cut

#: A key with more rows than this is cut into pieces of time, PIECES at most.
HOT_ROWS, PIECES = 1_000_000, 256
#: Hot keys are broadcast up to so many; their number is bounded by the rows divided by HOT_ROWS.
FEW = 10_000


def _pieces(rows: DataFrame, key: list[str], time: str, hot_rows: int) -> DataFrame | None:
    """(key, _cuts) of hot keys: the times at which they are cut. None if there are none."""
    hot = rows.groupBy(*key).count().where(F.col("count") > hot_rows).select(*key)
    if hot.isEmpty():
        return None
    shares = F.array(*(F.lit(k / PIECES) for k in range(1, PIECES)))
    return cut(rows.join(F.broadcast(hot) if hot.count() <= FEW else hot, key).groupBy(*key).agg(F.array_distinct(F.percentile_approx(time, shares, F.lit(10_000))).alias("_cuts")))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def _piece(time: str) -> Column:
    """How many cuts lie before a time; 0 for keys without cuts."""
    return F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(time))))


def as_of(left: DataFrame, right: DataFrame, key: list[str], left_time: str, right_time: str, name: str = "as_of", order: tuple[str, ...] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """left with, as the struct `name`, the right row of its key that is newest at or before its time; null if there is none.
    order: columns of the right side that tell which of several rows at one time is the last.

    Both sides are laid together and sorted by time, and the last right row seen is carried on; no row of one side is paired with rows of the
    other that it does not keep. Right rows at one time are reduced to the last before anything is sorted.
    """
    usable = lambda df, t: F.expr(" and ".join(f"`{c}` is not null" for c in (*key, t)))
    rank = F.struct(*order) if order else F.struct(F.xxhash64(*right.columns))
    newest = right.where(usable(right, right_time)).groupBy(*key, F.col(right_time).alias("_t")).agg(F.max_by(F.struct(*right.columns), rank).alias("_right"))
    known = left.where(usable(left, left_time))
    both = known.select(*key, F.col(left_time).alias("_t"), F.struct("*").alias("_left"), F.lit(None).cast(newest.schema["_right"].dataType).alias("_right"))
    both = both.unionByName(newest.select(*key, "_t", F.lit(None).cast(both.schema["_left"].dataType).alias("_left"), "_right"))
    cuts = _pieces(both, key, "_t", hot_rows)
    piece = F.lit(0) if cuts is None else _piece("_t")
    rows = (both if cuts is None else both.join(_few(cuts), key, "left")).withColumn("_piece", piece)
    so_far = Window.partitionBy(*key, "_piece").orderBy("_t", F.col("_left").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_found", F.last("_right", ignorenulls=True).over(so_far)).where("_left is not null")
    if cuts is not None:  # the last right row of each piece goes on to the later ones
        ends = rows.where("_right is not null and _cuts is not null").groupBy(*key, "_piece").agg(F.max_by("_right", "_t").alias("_last"))
        every = cuts.select(*key, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_piece"))
        earlier = Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
        handed = every.join(ends, [*key, "_piece"], "left").select(*key, "_piece", F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
        found = found.join(_few(cut(handed)), [*key, "_piece"], "left").withColumn("_found", F.coalesce("_found", "_handed"))
    lost = left.where(~F.coalesce(usable(left, left_time), F.lit(False))).select("*", F.lit(None).cast(newest.schema["_right"].dataType).alias(name))
    return found.select("_left.*", F.col("_found").alias(name)).unionByName(lost)


def overlapping(left: DataFrame, right: DataFrame, key: list[str], left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("start", "end")) -> DataFrame:
    """(left, right): structs of rows of one key whose spans [start, end) share a moment. Empty spans and those with null ends have none.

    A span has a level, the power of two (in microseconds) that is not below its length, so that it meets at most two buckets of that width; this is its home.
    Two spans meet at the level of the longer one: its home against the other's buckets of that level, again two at most. So a
    row is posted twice for each level that is there, whatever the lengths, and reported in the bucket of the later start only.
    """

    def spans(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        start, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in span)
        rows = df.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(key)), start.alias("_a"), end.alias("_b"), F.struct("*").alias(side)).where("_a < _b")
        return rows.where(" and ".join(f"_k{n} is not null" for n in range(len(key)))).withColumn("_level", F.ceil(F.log2((F.col("_b") - F.col("_a")).cast("double"))).cast("int"))

    l, r = cut(spans(left, left_span, "left")), cut(spans(right, right_span, "right"))  # each is read three times
    levels = lambda df: sorted(x["_level"] for x in df.select("_level").distinct().collect())  # noqa: E731  64 numbers at most

    def posted(df: DataFrame, names: list[str], levels: list[int], strictly: bool) -> DataFrame:
        """A row for each bucket that a span meets at each of the levels from its own (or the next) on."""
        wanted = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col("_level") if strictly else x >= F.col("_level"))
        at = df.withColumn("_at", F.explode(wanted))
        return at.withColumn("_bucket", F.explode(F.sequence(F.expr("shiftright(_a, _at)"), F.expr("shiftright(_b - 1, _at)")))).select(*names)

    keys = [f"_k{n}" for n in range(len(key))]
    own = lambda df: df.withColumn("_at", F.col("_level")).withColumn("_bucket", F.explode(F.sequence(F.expr("shiftright(_a, _at)"), F.expr("shiftright(_b - 1, _at)"))))

    def met(home: DataFrame, visiting: DataFrame, strictly: bool, home_side: str, other_side: str) -> DataFrame:
        h = own(home).select(*keys, "_at", "_bucket", F.col("_a").alias("_ha"), F.col("_b").alias("_hb"), home_side)
        v = posted(visiting, [*keys, "_at", "_bucket", "_a", "_b", other_side], levels(home), strictly)
        pairs = h.join(v, [*keys, "_at", "_bucket"]).where("_ha < _b and _a < _hb and shiftright(greatest(_ha, _a), _at) = _bucket")
        return pairs.select("left", "right")

    return met(l, r, False, "left", "right").unionByName(met(r, l, True, "right", "left"))


def trailing(rows: DataFrame, key: list[str], time: str, seconds: int, totals: dict[str, Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows with aggregates over those of the same key in the last so many seconds up to and including each row's time.

    A hot key is cut at multiples of the span: a row is then also posted to the next piece, where it is only looked back upon. Rows without a time have nulls.
    """
    span, at = seconds * 1_000_000, F.unix_micros(F.col(time).cast("timestamp"))
    timed = rows.where(F.col(time).isNotNull()).withColumn("__t", at)
    hot = timed.groupBy(*key).count().where(F.col("count") > hot_rows).select(*(F.col(k).alias(f"__{k}") for k in key))
    piece = F.floor(F.col("__t") / span).cast("long")
    if hot.isEmpty():
        posted = timed.withColumn("__piece", F.lit(0).cast("long")).withColumn("__own", F.lit(True))
    else:
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
        marked = timed.join(_few(cut(hot.withColumn("__hot", F.lit(True)))), same, "left")
        posted = marked.withColumn("__piece", F.explode(F.when(F.col("__hot"), F.array(piece, piece + 1)).otherwise(F.array(F.lit(0).cast("long")))))
        posted = posted.withColumn("__own", F.col("__hot").isNull() | (F.col("__piece") == piece))
    frame = Window.partitionBy(*key, "__piece").orderBy("__t").rangeBetween(-span, Window.currentRow)
    out = posted.select(*rows.columns, "__own", *(c.over(frame).alias(n) for n, c in totals.items())).where("__own").drop("__own")
    untimed = rows.where(F.col(time).isNull()).select("*", *(F.lit(None).cast(out.schema[n].dataType).alias(n) for n in totals))
    return out.unionByName(untimed)
