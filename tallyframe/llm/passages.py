"""Repeated passages by line hashing.

A line is cut further at the ends of sentences and clauses, so that a passage is found inside a paragraph too, but for less than a
clause at each end. Units are normalised (words in
lower case, single spaces), hashed to 96 bits and grouped by digest over the whole corpus; the document with the smallest id keeps
a unit, its first occurrence there, and every other occurrence is a repeat (repeated_units gives them all). Units are short and short ones
repeat by chance in nearly every document, so only runs of neighbouring repeats with enough words together are removed; their places in the
original text are what the operator returns.

A digest reaches the shuffle once for a task and document at most, counts are combined before it, and the join on digests has one
row for each on one side, so that a line in a third of all documents can be split. Cases: null and empty texts have no units. Rows that share an id
count as one document and are not compared with each other; rows without an id only lose what they repeat themselves. Equal rows give
their runs once. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, nested, table, text_batches
from tallyframe.llm.secrets import redact

#: Words that a run of repeated units needs to be removed.
LEAST_WORDS = 25
_UNIT = re.compile(r"[^\n.!?,;:]*[.!?,;:\n]+|[^\n.!?,;:]+")
_WORD = re.compile(r"\w+")
_SCHEMA = "doc_id long, version long, unit int, start int, end int, words int, again boolean, d0 long, d1 int"


def units(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each unit that has words; the end is without trailing white space."""
    out = []
    for m in _UNIT.finditer(text):
        words = _WORD.findall(m[0].lower())
        if words:
            raw = m[0]
            a, b = len(raw) - len(raw.lstrip()), len(raw.rstrip())
            out.append((m.start() + a, m.start() + b, len(words), xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))))
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, numbers, digests, again = [], [], [], []
        for k, text in enumerate(batch.column(1).to_pylist()):
            if not text:
                continue
            seen: set[bytes] = set()
            version = np.frombuffer(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "<i8")[0]
            for n, (start, end, words, digest) in enumerate(units(text)):
                doc.append(k)
                numbers.append((version, n, start, end, words))
                digests.append(digest)
                again.append(digest in seen)
                seen.add(digest)
        n = np.array(numbers, np.int64).reshape(-1, 5)
        d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        small = [pa.array(n[:, c].astype(np.int32)) for c in range(1, 5)]
        columns = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(n[:, 0]), *small, pa.array(again, pa.bool_()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])


def _repeated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every unit that repeats one before it: doc_id, version (a digest of the text), unit, start, end, words, first (the id that keeps it)."""
    found = text_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(_units, _SCHEMA)
    several = found.where("not again and doc_id is not null").groupBy("d0", "d1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    several = cut(several)  # else it would come grouped by digest already, and the join could not split a digest's rows
    repeated = found.join(several, ["d0", "d1"], "left").where("again or doc_id > first")
    return repeated.select("doc_id", "version", "unit", "start", "end", "words", F.coalesce("first", "doc_id").alias("first")).distinct()


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each repeated unit, however short: doc_id, start, end, n_words, kept_doc_id."""
    return _repeated(docs, id_col, text_col).select("doc_id", "start", "end", F.col("words").cast("long").alias("n_words"), F.col("first").alias("kept_doc_id"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each removed run: doc_id, start, end (code points, end exclusive), n_units, n_words, kept_doc_id (the smallest id that keeps one of its units)."""
    in_text = Window.partitionBy("doc_id", "version").orderBy("unit")
    runs = _repeated(docs, id_col, text_col).withColumn("run", F.col("unit") - F.row_number().over(in_text)).groupBy("doc_id", "version", "run")
    wide = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"), F.sum("words").alias("n_words"), F.min("first").alias("kept_doc_id"))
    return wide.where(F.col("n_words") >= least_words).select("doc_id", "start", "end", "n_units", "n_words", "kept_doc_id")


def without(text: Column, runs: Column) -> Column:
    """The text without the given array of (start, end)."""
    return redact(text, F.array_sort(runs), "")


def removed(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the runs found in them. The id has to be unique."""
    of_doc = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    rows = docs.select(nested(docs), F.col(id_col).alias("id")).join(of_doc, "id", "left")
    text = F.col(f"row.`{text_col}`")
    new = F.when(F.col("runs").isNull(), text).otherwise(without(text, F.col("runs")))
    return rows.select(*(new.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_line_dedup starts from, without its floor: every repeated unit."""
    return repeated_units(table(spark, sf_dir, "documents"))


SQL_LINES = rf"""
with cut as (
  select doc_id, text, unnest(regexp_extract_all(text, '[^\n.!?,;:]*[.!?,;:\n]+|[^\n.!?,;:]+')) as raw, generate_subscripts(regexp_extract_all(text, '[^\n.!?,;:]*[.!?,;:\n]+|[^\n.!?,;:]+'), 1) as k from documents),
placed as (select *, sum(length(raw)) over (partition by doc_id order by k) - length(raw) as pos, regexp_extract_all(lower(raw), '[\pL\pN_\pM]+') as w from cut),
units as (
  select doc_id, row_number() over (partition by doc_id order by k) as unit, len(w) as words, md5(list_aggregate(w, 'string_agg', ' ')) as d,
    pos + length(raw) - length(ltrim(raw, E' \n\t\r')) as start, pos + length(rtrim(raw, E' \n\t\r')) as stop
  from placed where len(w) > 0),
marked as (select *, row_number() over (partition by doc_id, d order by unit) > 1 as again, min(doc_id) over (partition by d) as first from units),
runs as (select *, unit - row_number() over (partition by doc_id order by unit) as run from marked where again or doc_id > first)
select doc_id, min(start)::int as start, max(stop)::int as "end", count(*) as n_units, sum(words)::bigint as n_words, min(first) as kept_doc_id
from runs group by doc_id, run having sum(words) >= {LEAST_WORDS}
"""

SQL_UNITS = SQL_LINES[: SQL_LINES.index(",\nruns as (")] + """
select doc_id, start::int as start, stop::int as "end", words::bigint as n_words, first as kept_doc_id from marked where again or doc_id > first
"""

QUERIES = {"op6_line_dedup": op6_line_dedup, "repeated_lines": repeated_lines}
#: For tables whose ids are unique.
SQL = {"op6_line_dedup": SQL_LINES, "repeated_lines": SQL_UNITS}
