"""Hard negatives from sorted scores.

Scores are inner products of whole-number vectors, so they are exact and ties are real. Rows and anchors are dealt into blocks, and each pair of a
block of rows and one of anchors is one task. A first pass keeps each anchor's best rows of its own label, its positives. A second one sorts, for
each anchor, the scores of a block's rows of other labels by score and id; binary search finds where each positive's upper limit lies, and the rows from there
on that are above its lower limit are read, as many as asked for. The best of all blocks together are the anchor's negatives for that positive.

Every anchor meets every row, as is asked for: the comparisons grow with both. A row is moved once for each ANCHORS anchors of the table, which take
a thousand times longer to score and sort than the row to move. No task holds more than a block of each side and TOGETHER rows of scores.

Cases: rows with a null id or label, or a vector that is null, empty or holds null or non-finite components, take no part; zero vectors do. Vectors of different lengths
are not compared. Components beyond 2 ** 28 / sqrt(length) are held there, so that scores fit. Rows that share an id are rows of their own, and each anchor row has lists of
its own. A positive with a score below zero has limits that nothing satisfies. Fewer rows than asked for: all of them. An empty table gives an empty result. Labels are
compared as text. Only the id, the vector and the label are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, table

#: Rows and anchors that meet in a task; the fewest blocks of rows; anchors whose scores are held at once.
ROWS, ANCHORS, LEAST, TOGETHER = 8192, 4096, 12, 32


def whole(vector: Column, quanta: int) -> Column:
    """floor(quanta * x) of each component, as little-endian 32-bit numbers; null if the vector can't take part."""

    @F.pandas_udf("binary")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            out = []
            for v in vectors:
                a = np.zeros(0) if v is None else np.asarray(v, np.float64)
                most = math.isqrt((1 << 56) // max(1, len(a)))
                out.append(np.clip(np.floor(quanta * a), -most, most).astype("<i4").tobytes() if len(a) and np.isfinite(a).all() else None)
            yield pd.Series(out, dtype=object)

    return of(vector.cast("array<double>"))


def _matrix(parts: pd.Series) -> np.ndarray:
    """Rows as doubles if every product is exact in them, else as whole numbers."""
    m = np.frombuffer(b"".join(parts), "<i4").reshape(len(parts), -1).astype(np.int64)
    return m.astype(np.float64) if len(m) and int(np.abs(m).max()) ** 2 * m.shape[1] < 1 << 52 else m


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if anchors.dtype != rows.dtype:
        anchors, rows = anchors.astype(np.int64), rows.astype(np.int64)
    return (anchors @ rows.T).astype(np.int64)


def _positives(k: int):
    """The best k rows of each anchor's label in a block of rows."""

    def of(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            a, r, ids, uid, label = _matrix(anchors["v"]), _matrix(rows["v"]), rows["vec_id"].to_numpy(), rows["uid"].to_numpy(), rows["label"].to_numpy()
            same = {name: np.flatnonzero(label == name) for name in set(label)}
            for own, part in anchors.assign(at=np.arange(len(anchors))).groupby("label")["at"]:
                at = same.get(own, np.zeros(0, int))
                for low in range(0, len(part) if len(at) else 0, TOGETHER):
                    some = part.to_numpy()[low : low + TOGETHER]
                    for x, score in zip(some, _scores(a[some], r[at]), strict=True):
                        others = uid[at] != anchors["uid"].iat[x]
                        best = np.argsort(-score[others], kind="stable")[:k]  # rows stand by id, so ties go to the smaller
                        out += [(anchors["uid"].iat[x], anchors["vec_id"].iat[x], ids[at][others][b], score[others][b], uid[at][others][b]) for b in best]
        return pd.DataFrame(out, columns=["uid", "anchor_id", "positive_id", "positive_score", "row"])

    return of


def limited(score: np.ndarray, positive: int, low: int, high: int, k: int) -> tuple[int, int]:
    """Where in descending scores the first k begin and end with low * positive <= 100 * score <= high * positive."""
    ascending = score[::-1]
    first = len(score) - int(np.searchsorted(ascending, high * positive // 100, "right"))
    stop = len(score) - int(np.searchsorted(ascending, -(-low * positive // 100), "left"))
    return first, max(first, min(first + k, stop))


def _negatives(k: int, low: int, high: int):
    """For each anchor and positive the first k rows of other labels within the limits, of a block of rows."""

    def of(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(anchors) and len(rows):
            rows = rows.sort_values("vec_id", kind="stable")
            a, r, ids, uid, label = _matrix(anchors["v"]), _matrix(rows["v"]), rows["vec_id"].to_numpy(), rows["uid"].to_numpy(), rows["label"].to_numpy()
            for at in range(0, len(anchors), TOGETHER):
                part = anchors.iloc[at : at + TOGETHER]
                for x, own, positives, score in zip(part["uid"], part["label"], part["positives"], _scores(a[at : at + TOGETHER], r), strict=True):
                    other = np.flatnonzero(label != own)
                    order = other[np.lexsort((ids[other], -score[other]))]
                    falling = score[order]
                    for p in positives:
                        first, stop = limited(falling, int(p["score"]), low, high, k)
                        out += [(x, p["place"], ids[n], score[n], uid[n]) for n in order[first:stop]]
        return pd.DataFrame(out, columns=["uid", "place", "negative_id", "negative_score", "row"])

    return of


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, quanta: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = ROWS, together: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor: which rows are anchors. Limits are hundredths of a positive's score."""
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("asks"), whole(F.col(vector_col), quanta).alias("v"))
    base = cut(picked.where("vec_id is not null and label is not null and v is not null").withColumn("uid", F.monotonically_increasing_id()))
    n, asked = base.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    blocks, chunks = max(LEAST, -(-n // block)), max(1, -(-asked // together))
    deal = lambda salt, ways: F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(ways)).cast("int")
    every = lambda ways: F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))
    key = ["size", "chunk", "block"]
    right = base.select(F.length("v").alias("size"), deal("r", blocks).alias("block"), "uid", "vec_id", "label", "v", every(chunks).alias("chunk")).groupBy(*key)
    anchors = base.where("asks").select(F.length("v").alias("size"), deal("a", chunks).alias("chunk"), "uid", "vec_id", "label", "v")
    found = anchors.withColumn("block", every(blocks)).groupBy(*key).cogroup(right).applyInPandas(_positives(positives), "uid long, anchor_id long, positive_id long, positive_score long, row long")
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "row"))
    found = cut(found.withColumn("place", place).where(F.col("place") <= positives).drop("row"))
    of_anchor = found.groupBy("uid").agg(F.collect_list(F.struct("place", F.col("positive_score").alias("score"))).alias("positives"))  # `positives` of them
    asking = anchors.join(of_anchor, "uid").select(*(F.col(c).alias(c) for c in (*anchors.columns, "positives")), every(blocks).alias("block"))
    hard = asking.groupBy(*key).cogroup(right).applyInPandas(_negatives(negatives, low, high), "uid long, place int, negative_id long, negative_score long, row long")
    rank = F.row_number().over(Window.partitionBy("uid", "place").orderBy(F.desc("negative_score"), "negative_id", "row"))
    best = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return best.join(found, ["uid", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(e.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


#: For tables with unique ids and vectors of one length.
PLAIN = """
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.e, b.e)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score qualify rank <= 5
"""

QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {"op13_hard_negatives": PLAIN}
