"""Near-duplicate vectors by a pivot-permutation index.

Reference points, pivots, are a bounded sample of the vectors themselves. A vector is described by its permutation: the SHARED
nearest pivots in order of nearness. Beside it stand the pivots that can be among the SHARED nearest of any vector linked to
it. With unit vectors at most r apart, a pivot q is surely nearer than p to every linked vector if <y, q> - <y, p> > r * |q - p|, so p can
be dropped once that holds for SHARED pivots q. The inverted list of a pivot holds the vectors that it is nearest to, and those that can be
linked to one of them; two vectors meet in the list of their two nearest pivots, in just one place. There the pivots that they share are counted: all of
each one's permutation must be among the other's possible pivots. Pairs with the full count are verified by their cosine. By the
bound no link is lost. Lists too long for one task are dealt out as pairs of blocks.

Postings carry the vector (as floats, if components are floats): fetching vectors only for pairs that pass would mean to emit these
pairs, and a group of near copies has as many of them as the square of its size, while blocks repeat a vector once in BLOCK partners.

Equal vectors are one node with a count, so copies are never paired; a block returns counts and a spanning forest of its
links, never the pairs. Cases: vectors that are null, empty, zero or hold null or non-finite components, and those with null
labels, link with nothing and are kept; so do vectors of different lengths with each other. Rows that repeat an id are
vectors of their own that share it. A row with a null id links like others, but names no component unless all its ids are null.
An empty table gives an empty result. Only the id, the vector and the label are read, so other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded, by_component, components, cut, forest, table
from tallyframe.llm.vectors import element, packed, unpacked, units

#: Pivots: as many as the root of the number of vectors (of a length) divided by 8, within these bounds. So lists grow with the root of the table up to
#: (8 * MOST) ** 2, some 10^9 vectors of a length; beyond, they grow with it, still as pairs of blocks of bounded size.
LEAST, MOST = 16, 4096
#: Vectors whose cosines to all pivots are held at once.
DESCRIBED = 1024
#: Vectors on one side of a block.
BLOCK = 1024
#: Pivots of a permutation.
SHARED = 4
#: Surviving pairs that are verified at once, so that vectors of pairs stay small.
TOGETHER = 50_000


def _pivots(nodes: DataFrame, count: int | None, seed: int, dtype: str) -> dict[int, np.ndarray]:
    """Unit pivots by length of vectors: samples of bounded size, for each of the commonest lengths. count: how many of each, else by the number of vectors of the length."""
    found = {}
    for n, rows in [tuple(r) for r in nodes.groupBy("bytes").count().orderBy(F.desc("count"), "bytes").limit(64).collect()]:
        some = nodes.where(F.col("bytes") == n).select("vector").orderBy(F.xxhash64(F.lit(seed), "vector"), "vector").limit(count or max(LEAST, min(MOST, int(rows**0.5 / 8)))).collect()
        found[n] = units(unpacked(pd.Series([bytes(r[0]) for r in some]), dtype))
    return found


def permutations(unit: np.ndarray, pivots: np.ndarray, reach: float, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors: the nearest pivots in order; which can be nearest for a vector within reach; which can be among its `shared` nearest."""
    near = unit @ pivots.T
    shared = min(shared, len(pivots))
    order = np.argsort(-near, axis=1, kind="stable")[:, :shared].astype(np.int32)
    surely = np.zeros(near.shape, np.int8)  # how many of the nearest pivots are nearer than p to whatever is in reach
    for k in range(shared):
        some, q = np.unique(order[:, k], return_inverse=True)
        apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots[some] @ pivots.T)))
        surely += near[np.arange(len(unit)), order[:, k]][:, None] - near > reach * apart[q] + 1e-9
    return order, surely < 1, surely < shared


def _described(nodes: DataFrame, pivots: dict[int, np.ndarray], threshold: float, dtype: str) -> DataFrame:
    """The nodes with order (the permutation, as bytes), possible (a bit for each pivot) and list (pivots whose lists it is in)."""
    held = nodes.sparkSession.sparkContext.broadcast(pivots)
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7

    @F.pandas_udf("home int, list array<int>, `order` binary, possible binary")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vectors in parts:
            out: dict[str, list] = {"home": [0] * len(vectors), "list": [np.zeros(1, np.int32)] * len(vectors), "order": [bytes(2)] * len(vectors), "possible": [b"\x80"] * len(vectors)}
            size = vectors.map(len).to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                if (p := held.value.get(int(n))) is None:
                    continue  # lengths too rare to have pivots: one list, in which all may be linked
                for low in range(0, len(at), DESCRIBED):
                    own = at[low : low + DESCRIBED]
                    order, first, some = permutations(units(unpacked(vectors.iloc[own], dtype)), p, reach)
                    for k, o, f, b in zip(own, order, first, np.packbits(some, axis=1), strict=True):
                        out["home"][k], out["list"][k], out["order"][k], out["possible"][k] = int(o[0]), np.flatnonzero(f).astype(np.int32), o.astype("<i2").tobytes(), b.tobytes()
            yield pd.DataFrame(out)

    return nodes.withColumn("_p", of("vector")).select("node", "n", "label", "bytes", "vector", "_p.home", "_p.list", "_p.order", "_p.possible")


def _counted(order: np.ndarray, possible: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share all pivots: the permutation of each lies within the possible pivots of the other."""
    near = np.zeros(possible.shape, np.float32)
    near[np.arange(len(order))[:, None], order] = 1
    may, full = possible.astype(np.float32), order.shape[1] - 0.5
    return (near[left] @ may[right].T > full) & (may[left] @ near[right].T > full)


def _verified(threshold: float, dtype: str):
    """For each list pair of blocks: node, links (vectors linked to it there), root (smallest node of its component there)."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        side = rows["side"].to_numpy()
        unit, n, node = units(unpacked(rows["vector"], dtype)), rows["n"].to_numpy(), rows["node"].to_numpy()
        if rows["p"].iloc[0] == rows["q"].iloc[0]:
            own, x, y = rows["own"].to_numpy(), rows["x"].iloc[0], rows["y"].iloc[0]
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        else:
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        order = np.frombuffer(b"".join(rows["order"]), "<i2").reshape(len(rows), -1)
        possible = np.unpackbits(np.frombuffer(b"".join(rows["possible"]), np.uint8).reshape(len(rows), -1), axis=1)
        pair = _counted(order, possible, left, right)
        if rows["p"].iloc[0] == rows["q"].iloc[0] and x == y:
            pair = np.triu(pair, 1)
        i, j = np.nonzero(pair)
        i, j = left[i], right[j]
        hit = [np.einsum("ij,ij->i", unit[i[a : a + TOGETHER]], unit[j[a : a + TOGETHER]]) >= threshold for a in range(0, len(i), TOGETHER)]
        hit = np.concatenate([*hit, np.zeros(0, bool)])
        i, j = i[hit], j[hit]
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        by_node = np.argsort(node)
        place = np.argsort(by_node)
        root = node[by_node[forest(len(rows), place[i], place[j])[place]]]
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": node[some], "links": links[some], "root": root[some]})

    return of


def _links(nodes: DataFrame, threshold: float, count: int | None, block: int, seed: int, dtype: str) -> DataFrame:
    described = cut(_described(nodes, _pivots(nodes, count, seed, dtype), threshold, dtype))
    carried = ("node", "n", "vector", "order", "possible")
    pair = described.select(*carried, "label", "bytes", "home", F.explode("list").alias("other")).select(
        *carried, "label", "bytes", F.least("home", "other").alias("p"), F.greatest("home", "other").alias("q"), (F.col("home") > F.col("other")).cast("int").alias("side")
    )
    key = ["label", "bytes", "p", "q"]
    blocks = lambda s: F.greatest(F.lit(1), F.ceil(F.sum((F.col("side") == s).cast("int")) / block)).cast("int")
    size = cut(pair.groupBy(*key).agg(blocks(0).alias("n0"), blocks(1).alias("n1")).where("n0 > 1 or n1 > 1"))
    mine, theirs = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")), F.when((F.col("side") == 1) | (F.col("p") == F.col("q")), F.col("n0")).otherwise(F.col("n1"))
    dealt = (
        pair.join(bounded(size), key, "left")
        .withColumn("n0", F.coalesce("n0", F.lit(1)))
        .withColumn("n1", F.coalesce("n1", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("node"), mine).cast("int"))
        .withColumn("opposite", F.explode(F.sequence(F.lit(0), theirs - 1)))
    )
    same = F.col("p") == F.col("q")
    x = F.when(same, F.least("own", "opposite")).when(F.col("side") == 0, F.col("own")).otherwise(F.col("opposite"))
    y = F.when(same, F.greatest("own", "opposite")).when(F.col("side") == 0, F.col("opposite")).otherwise(F.col("own"))
    return dealt.select(*key, x.alias("x"), y.alias("y"), "own", "side", *carried).groupBy(*key, "x", "y").applyInPandas(_verified(threshold, dtype), "node long, links long, root long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, pivots: int | None = None, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """One row per row: vec_id, n_links (other vectors linked directly) and component_id (smallest id reachable)."""
    own = cut(rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), packed(F.col(vector_col), dtype := element(rows, vector_col)).alias("vector")).withColumn("digest", F.sha2("vector", 256)))
    part = F.col("vector").isNotNull() & F.col("label").isNotNull()
    grouped = own.where(part).groupBy("label", "digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    nodes = cut(grouped.withColumn("node", F.monotonically_increasing_id()).withColumn("bytes", F.length("vector")))
    found = cut(_links(nodes, threshold, pivots, block, seed, dtype))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    named = nodes.select("node", "first").join(group, "node")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    named = by_component(named, least).select("node", "least")
    of_node = nodes.select("label", "digest", "node", "n", "first").join(links, "node", "left").join(named, "node", "left")
    of_node = of_node.select("label", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    linked = own.where(part).join(of_node, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    return linked.unionByName(own.where(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op8_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: For small tables: all pairs, and links followed from each vector.
ALL_PAIRS = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null and vec_id is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x)
select e.vec_id, (select count(*) from links where x = e.vec_id) as n_links, least(e.vec_id, coalesce((select min(y) from reach where x = e.vec_id), e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce((select min(y) from reach where x = e.vec_id), e.vec_id)) as kept
from embeddings e
"""

QUERIES = {"op8_pivot_near_dedup": op8_pivot_near_dedup}
SQL = {"op8_pivot_near_dedup": ALL_PAIRS}
