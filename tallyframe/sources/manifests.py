"""Manifests, record files and tables: reading and writing."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.plans.schemas import FILE_RECORD, MANIFEST, RECORD_KEYS


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """File records, one JSON object a line. Blank and broken lines are skipped, and so are records without a required key if strict."""
    rows = spark.read.schema(FILE_RECORD).option("mode", "DROPMALFORMED").json(path)
    if strict:
        for k in RECORD_KEYS:
            rows = rows.where(F.col(k).isNotNull())
    return rows


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime) of records in a file, the last line of a path counting."""
    rows = spark.read.schema("path string, mtime double").option("mode", "DROPMALFORMED").json(path).where("path is not null and mtime is not null")
    return rows.withColumn("_o", F.monotonically_increasing_id()).groupBy("path").agg(F.max_by("mtime", "_o").alias("mtime"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header, records) of a JSON manifest. Anything but an object with a list of records is an error."""
    whole = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = whole.withColumn("records", F.when(F.col("records").isNotNull(), F.col("records")).otherwise(F.raise_error(F.lit("manifest.records must be a list")).cast(whole.schema["records"].dataType)))
    rows = checked.select(F.posexplode("records").alias("ord", "r")).where("r is not null").select(F.col("ord").cast("long").alias("ord"), "r.*")
    return whole.drop("records"), rows


def read_array(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """The objects of a JSON array in a file, in order. strict: anything else in it is an error, otherwise it is left out."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def last_line(spark: SparkSession, path: str) -> str:
    """The last line that is not blank, trimmed; empty if there is none."""
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("_o", F.monotonically_increasing_id())
    found = rows.agg(F.max_by("value", "_o")).first()[0]
    return found.strip() if found else ""


def write_manifest(spark: SparkSession, records: DataFrame, path: str, source: str, generated_at: str | None = None, **header: str) -> None:
    """A manifest as one JSON object, keys sorted, with the time of writing if none is given. It is a document for one
    reader, so one task writes it; write_records is for inventories of any size."""
    at = F.lit(generated_at) if generated_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    names = sorted(records.columns)
    rows = records.groupBy().agg(F.sort_array(F.collect_list(F.struct(*names))).alias("records"))
    fields = {"source": F.lit(source), "generated_at": at, "records": F.col("records"), **{k: F.lit(v) for k, v in header.items()}}
    rows.select(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"pretty": "true", "ignoreNullFields": "false"})).coalesce(1).write.mode("overwrite").text(path)


def write_records(records: DataFrame, path: str) -> None:
    """Appends records, one JSON object a line."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds, read in parallel by ranges of it."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def create_tables(spark: SparkSession, statements: list[str]) -> None:
    """Runs DDL in order; with CREATE TABLE IF NOT EXISTS running it again changes nothing."""
    for s in statements:
        spark.sql(s)


def migrate(spark: SparkSession, folder: str, history: str) -> list[str]:
    """Applies the files of a folder (*.sql, statements that end with a semicolon at the end of a line) in order of their names, those that the history (a folder of JSON rows) doesn't
    name yet. Each is written down once it has been applied whole, so that a run that broke off goes on with the file that failed. Returns the names that were applied."""
    from pyspark.errors import AnalysisException

    rows = spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    try:
        known = {r["name"] for r in spark.read.schema("name string, at timestamp").json(history).collect()}  # a row for each file
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = set()
    applied = []
    for r in sorted(rows.collect(), key=lambda r: r["name"]):  # scripts, which the driver runs
        if r["name"] in known:
            continue
        for statement in (x.strip().rstrip(";").strip() for x in re.split(r";[ \t]*(?:\n|$)", r["value"])):
            if statement:
                spark.sql(statement)
        spark.range(1).select(F.lit(r["name"]).alias("name"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(history)
        applied.append(r["name"])
    return applied


def control_row(spark: SparkSession, path: str, default: str, schema: str) -> DataFrame:
    """The newest state in a control table of one JSON row a write, or the default (JSON) if there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(f"{schema}, at timestamp").json(path)
        if not rows.isEmpty():
            return rows.orderBy(F.desc("at")).limit(1).drop("at")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    return spark.createDataFrame([json.loads(default)], schema)


def set_control(spark: SparkSession, path: str, state: dict, schema: str) -> None:
    spark.createDataFrame([state], schema).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
