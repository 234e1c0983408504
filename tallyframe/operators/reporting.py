"""Reports: throughput, duplicates as text, provider health, moving figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.duplicates import by_size
from tallyframe.operators.graph import numbered


def throughput(total_bytes: Column, total_files: Column, seconds: Column) -> Column:
    """A struct of rates; zeros if no time has passed."""
    s = F.when(seconds > 0, seconds)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rate = total_bytes / s
    return F.struct(zero(F.bround(s, 3)).alias("elapsed_seconds"), zero(F.bround(rate, 2)).alias("bytes_per_second"), zero(F.bround(total_files / s, 2)).alias("files_per_second"), zero(F.bround(rate / 1048576.0, 3)).alias("mb_per_second"))


def throughput_summary(files: DataFrame, seconds: float) -> DataFrame:
    total = files.agg(F.sum("size").cast("double").alias("b"), F.count("*").cast("double").alias("n"))
    return total.select(throughput(F.coalesce("b", F.lit(0.0)), F.col("n"), F.lit(float(seconds))).alias("t")).select("t.*")


def duplicate_report(groups: DataFrame) -> DataFrame:
    """(line_no, line): a heading and a line per group, largest first; one line if there are none."""
    spark = groups.sparkSession
    groups = numbered(groups, F.desc("n"), "first_ord")
    number = (F.col("number") + 1).cast("int")
    line = F.format_string("%d. hash=%s size=%d mime=%s instances=%d providers=[%s]", number, "content_hash", "size", "mime_type", "n", F.array_join(F.transform("providers", lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", "))
    body = groups.select((F.col("number") + 2).cast("long").alias("line_no"), line.alias("line"))
    some = groups.limit(1).select(F.lit(True).alias("some"))
    one = spark.range(1).join(some, F.lit(True), "left")
    head = one.select(F.when(F.col("some"), F.array(F.lit("Duplicate Groups"), F.lit("================"))).otherwise(F.array(F.lit("No duplicate groups detected."))).alias("h"))
    return head.select(F.posexplode("h").alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line").unionByName(body)


def largest_groups(groups: DataFrame, k: int) -> DataFrame:
    return by_size(groups).limit(k)


def sync_dashboard(states: DataFrame) -> DataFrame:
    """Providers by id, healthy if they have no last error, with the counts of all and of healthy ones."""
    rows = states.withColumn("healthy", F.col("last_error").isNull())
    total = rows.agg(F.count("*").alias("provider_count"), F.count_if("healthy").alias("healthy_count"))
    return rows.join(total, F.lit(True)).orderBy("provider_id")


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, width: int = 30) -> DataFrame:
    """Mean of a row's value and those before it in its key, and the largest so far."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("moving_average", F.avg(value).over(w.rowsBetween(-(width - 1), 0))).withColumn("peak", F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def progress_snapshots(rows: DataFrame, key: str, total: Column, order: list[str], seconds: Column) -> DataFrame:
    """Files done so far in a key, files per second and the seconds left at that pace."""
    done = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    pace = F.when(seconds > 0, done / seconds)
    return rows.withColumn("done", done).withColumn("files_per_second", F.coalesce(pace, F.lit(0.0))).withColumn("eta_seconds", (total - done) / F.nullif(pace, F.lit(0.0)))


def latest(files: DataFrame, time: str, name: str) -> DataFrame:
    """The row with the latest time, the first by name among equals; none of an empty table."""
    return files.where(F.col(time).isNotNull()).orderBy(F.desc(time), name).limit(1)


def totals(rows: DataFrame, sets: list[list[str]], *measures: Column) -> DataFrame:
    """Measures for several groupings at once, from one pass over the rows: the grouped columns (null where a set leaves one out), the measures, and level, which has
    a bit for each column that is left out, the first column's the highest."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*measures, F.grouping_id(*columns).alias("level"))
