"""Product codes of vectors by Lloyd's rounds that are maintained by differences.

A vector is cut into equal parts, and each position of a part has a codebook of its own. Components are whole numbers, so that sums are
exact in any order. The assignments of each round are kept beside the vectors, and running sums and counts of each entry beside the codebooks. A round
reads the kept rows once, assigns each part to its nearest entry and, for parts whose assignment changed, adds to the new entry and takes from the old
one. A task gives these contributions as one row for each entry that they touch, so that the shuffle has no more rows than tasks times entries, and
fewer as assignments settle; the driver gets a row for each entry. If no assignment changes, later rounds would change nothing and are left out.

Cases: vectors that are null, empty or hold null or non-finite components are dropped, as are those of another length than the first one kept (by
id) or of a length that can't be cut into equal parts. Zero vectors take part. Fewer vectors than entries: as many entries as vectors. Equal rows count each; ties
in the starting entries go to the smaller vector, null ids come last. Components beyond 2 ** 30 / sqrt(length) quanta are held there, so that distances fit. Labels are compared as
text, nulls together. Only the id, the vector and the label are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import by_component, remove, shared_folder, table

PARTS, ENTRIES, ROUNDS, QUANTA = 8, 16, 6, 4096
#: Vectors whose distances are held at once.
TOGETHER = 4096


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts (rows, positions, components) the nearest entry of book (positions, entries, components) and the squared distance; ties to the lower index."""
    codes, far = [np.zeros((0, parts.shape[1]), np.int64)] * 2, []
    out = []
    for at in range(0, len(parts), TOGETHER):
        some = parts[at : at + TOGETHER]
        away = np.stack([((some[:, p, None, :] - book[p][None]) ** 2).sum(axis=2) for p in range(parts.shape[1])], axis=1)
        code = away.argmin(axis=2)
        out.append((code, np.take_along_axis(away, code[:, :, None], axis=2)[:, :, 0]))
    if not out:
        return codes[0], codes[1]
    codes, far = zip(*out, strict=True)
    return np.concatenate(codes), np.concatenate(far)


def differences(parts: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (positions, entries) and sums (positions, entries, components) that parts with a changed assignment add and take."""
    width, size = parts.shape[1:]
    count, total = np.zeros((width, entries), np.int64), np.zeros((width, entries, size), np.int64)
    for p in range(width):
        moved = np.arange(len(new)) if old is None else np.flatnonzero(old[:, p] != new[:, p])
        for codes, sign in ((new, 1), (old, -1)):
            if codes is not None:
                np.add.at(count[p], codes[moved, p], sign)
                np.add.at(total[p], codes[moved, p], sign * parts[moved, p])
    return count, total


def replaced(book: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The codebooks after a round; entries without parts stay."""
    return np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], book)


_SCHEMA = "vec_id long, label string, known boolean, v binary, code binary, error long, pos int, entry int, n long, sums array<long>"


def _round(book: np.ndarray, first: bool):
    """The rows with the codes and errors of this round, and, as rows of their own with pos, what changed."""
    width, entries, size = book.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((width, entries), np.int64), np.zeros((width, entries, size), np.int64)
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            parts = np.frombuffer(b"".join(col["v"].to_pylist()), "<i4").reshape(batch.num_rows, width, size).astype(np.int64)
            old = None if first else np.frombuffer(b"".join(col["code"].to_pylist()), np.uint8).reshape(batch.num_rows, width)
            code, away = nearest(parts, book)
            n, s = differences(parts, old, code, entries)
            count, total = count + n, total + s
            codes = pa.array([c.tobytes() for c in code.astype(np.uint8)], pa.binary())
            none = lambda kind, rows=batch.num_rows: pa.nulls(rows, kind)
            yield pa.RecordBatch.from_arrays([col["vec_id"], col["label"], col["known"], col["v"], codes, pa.array(away.sum(axis=1)), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64()))], names=names)
        pos, entry = np.nonzero((count != 0) | (total != 0).any(axis=2))
        k = len(pos)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(pos, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[pos, entry], pa.int64()), pa.array(total[pos, entry].tolist(), pa.list_(pa.int64()))], names=names)

    return of


def _whole(parts: int, quanta: int):
    """Vectors as whole numbers; those that can't take part are left out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, packed = [], []
            for k, v in enumerate(batch.column(2).to_pylist()):
                a = np.array(v, np.float64) if v and None not in v else np.zeros(0)
                if len(a) and len(a) % parts == 0 and np.isfinite(a).all():
                    most = math.isqrt((1 << 60) // len(a))
                    keep.append(k)
                    packed.append(np.clip(np.floor(quanta * a), -most, most).astype("<i4").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([True] * len(keep), pa.bool_()), pa.array(packed, pa.binary())], names=["vec_id", "label", "known", "v"])

    return of


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, quanta: int = QUANTA, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """The kept rows (vec_id, label as text, code, error), a code being a byte for each part, and the final codebooks (positions, entries, components)."""
    spark, at = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/codes-{uuid.uuid4().hex}"

    def keep(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
        return spark.read.parquet(f"{at}/{k}")

    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = keep(picked.mapInArrow(_whole(parts, quanta), "vec_id long, label string, known boolean, v binary"), 0)
    order = (F.col("vec_id").asc_nulls_last(), "v")
    size = kept.orderBy(*order).select(F.length("v")).first()
    if size is None:
        return kept.select("vec_id", "label", F.col("v").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    kept = kept.where(F.length("v") == size[0])
    start = [np.frombuffer(r["v"], "<i4").reshape(parts, -1).astype(np.int64) for r in kept.orderBy(*order).select("v").limit(entries).collect()]  # `entries` rows
    book = np.stack(start, axis=1)
    count, total = np.zeros(book.shape[:2], np.int64), np.zeros(book.shape, np.int64)
    for k in range(rounds + 1):
        kept = keep(kept.mapInArrow(_round(book, k == 0), _SCHEMA), k + 1)
        changed = kept.where("pos is not null").groupBy("pos", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[c]) for c in range(book.shape[2]))).alias("sums")).collect()  # a row for each entry
        kept = kept.where("pos is null").drop("pos", "entry", "n", "sums")
        if k == rounds or not changed:
            break
        for r in changed:
            count[r["pos"], r["entry"]] += r["n"]
            total[r["pos"], r["entry"]] += np.array(r["sums"], np.int64)
        book = replaced(book, count, total)
    return kept.select("vec_id", "label", "code", "error"), book


def decoded(code: bytes, book: np.ndarray, quanta: int = QUANTA) -> np.ndarray:
    """The vector that a code stands for: the middle of its entries' quanta."""
    return (np.concatenate([book[p, c] for p, c in enumerate(code)]) + 0.5) / quanta


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, book = codebooks(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    named = found.withColumn("component", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null")))
    whole = by_component(named, named.groupBy("component").agg(F.sum("error").alias("label_error")))
    return whole.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after the other, for tables with unique ids and vectors of one length."""
    part = "select vec_id, label, p, list_transform(embedding[p * len(embedding) // 8 + 1 : (p + 1) * len(embedding) // 8], lambda x: floor(4096 * x::double)::bigint) as v from embeddings, range(8) r(p)"
    sql = f"""with parts as materialized ({part} where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
b0 as materialized (select p, dense_rank() over (order by vec_id) - 1 as e, v from parts qualify e < {ENTRIES})"""
    for k in range(ROUNDS + 1):
        sql += f""",
a{k} as materialized (select vec_id, any_value(label) as label, p, arg_min(e, (d, e)) as e, min(d) as d, any_value(v) as v from (select vec_id, label, p, e, a.v, list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d from parts a join b{k} b using (p)) group by vec_id, p)"""
        if k < ROUNDS:
            sql += f""",
s{k} as (select p, e, i, sum(x)::bigint as s, count(*) as n from (select p, e, generate_subscripts(v, 1) as i, unnest(v) as x from a{k}) group by all),
b{k + 1} as materialized (select b.p, b.e, coalesce(m.v, b.v) as v from b{k} b left join (select p, e, list((s - ((s % n) + n) % n) // n order by i) as v from s{k} group by p, e) m using (p, e))"""
    return (
        sql
        + f""",
codes as (select vec_id, any_value(label) as label, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{ROUNDS} group by vec_id),
digest as (select sha256(string_agg(x, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, generate_subscripts(v, 1) as i, unnest(v)::varchar as x from b{ROUNDS}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from codes, digest"""
    )


QUERIES = {"op12_delta_lloyd": op12_delta_lloyd}
SQL = {"op12_delta_lloyd": _sql()}
