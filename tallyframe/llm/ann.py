"""Nearest neighbours by learned partitions.

From a bounded sample of distinct vectors the graph of nearest neighbours is cut into parts of equal size, moving vectors to
the part that most of their neighbours are in, within a capacity. A small network, the router, learns the parts in which a vector's
neighbours lie. It puts every vector of the table in its likeliest part and sends a query to its likeliest parts, as many
as hold the wanted share of neighbours on held-out vectors of the sample, and more if these hold fewer rows than asked for.
The parts that a query goes to are searched whole, and the best are merged and ranked by exact inner products.

Parts grow with the root of the table: one that is larger is cut again in the same way, by a router of its own that a task fits on a bounded sample of its
rows. So a tree has two levels and up to MOST_PARTS * MOST_PARTS leaves, and its routers, which are broadcast, some 25 MB at most.

Tasks hold bins of rows: several small leaves, or a piece of a large one. A query is shuffled once for each bin that it visits, and a row once for each
QUERIES_A_BLOCK queries that visit its bin: once, as long as a bin's queries are no more than that, whatever the size of the table.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id. Vectors of different lengths have no inner product:
a query finds rows of its own length, and lengths rarer than the commonest have one leaf each, which their queries search whole. Copies are candidates of their own; ties go to the smaller id. A query does not
find its own row but finds other rows of its id; each row that asks has a list of its own, also if ids repeat. Fewer candidates
than asked for: all are returned, as every part is then searched. An empty table gives an empty result. Only the id and the
vector are read, so other columns don't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import cut, table
from tallyframe.llm.vectors import element, packed, unpacked

#: Parts of a level grow with the table between these bounds. A leaf has about PART_ROWS rows, or the root of the table's if that is more.
PARTS, MOST_PARTS, PART_ROWS = 32, 128, 4096
#: The bound on the sample that a partition and its router are fitted on, for each part.
SAMPLE = 190
NEIGHBOURS, HIDDEN, EPOCHS, RECALL = 20, 128, 40, 0.94
#: Rows of the table, and queries, that meet in one task; the fewest bins, so that small tables use several cores.
BLOCK, QUERIES_A_BLOCK, LEAST_BINS = 32_768, 8_192, 8
#: Queries whose scores are held at once, and scores while the neighbours of a sample are looked for.
TOGETHER, SCORES = 128, 1 << 22


def _nearest(queries: np.ndarray, rows: np.ndarray, k: int, own: bool) -> np.ndarray:
    """The places of the k rows with the largest inner products, for each query, in no order. own: queries are the rows, and none finds itself.
    No more than SCORES scores are held at once, and of their order only the places."""
    out = np.empty((len(queries), min(k, len(rows))), np.int32)
    step = max(1, SCORES // max(1, len(rows)))
    for at in range(0, len(queries), step):
        score = queries[at : at + step] @ rows.T
        if own:
            score[np.arange(len(score)), at + np.arange(len(score))] = -np.inf
        np.negative(score, out=score)
        out[at : at + len(score)] = np.argpartition(score, min(k, score.shape[1] - 1), axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 30, slack: float = 1.05) -> np.ndarray:
    """A part for each row of the neighbour graph, none larger than slack times the mean. Rows move to where most of their
    neighbours are, those with most to gain first; full parts take no more."""
    n = len(near)
    room = int(np.ceil(slack * n / parts))
    part = np.full(n, -1)
    for p, seed in enumerate(rng.permutation(n)[:parts]):  # parts grow around seeds
        part[seed] = p
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        for k in range(near.shape[1]):
            known = part[near[:, k]] >= 0
            np.add.at(votes, (np.flatnonzero(known), part[near[known, k]]), 1)
            here = np.flatnonzero(part >= 0)
            np.add.at(votes, (near[here, k], part[here]), 1)
        size = np.zeros(parts, int)
        new = np.full(n, -1)
        votes += 1e-3 * rng.random(votes.shape)
        now = np.where(part >= 0, votes[np.arange(n), np.maximum(part, 0)], 0)
        choice = np.argsort(-votes, axis=1)
        for i in np.argsort(-(votes.max(axis=1) - 0.5 * now)):
            for p in choice[i]:
                if size[p] < room:
                    new[i], size[p] = p, size[p] + 1
                    break
        if (new == part).mean() > 0.995:
            return new
        part = new
    return part


class Router:
    """A network with one hidden layer whose output is a part's share of a vector's neighbours."""

    def __init__(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = HIDDEN, epochs: int = EPOCHS):
        self.scale = float(np.sqrt((x**2).mean())) or 1.0
        shapes = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
        self.w = [rng.normal(size=s) / np.sqrt(s[0]) if len(s) == 2 else np.zeros(s) for s in shapes]
        m, v, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                a, h, p = self._forward(x[rows])
                d = (p - target[rows]) / len(rows)
                dh = d @ self.w[2].T * (h > 0)
                t += 1
                for k, g in enumerate((a.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= 0.003 * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _forward(self, x: np.ndarray):
        a = x / self.scale
        h = np.maximum(0, a @ self.w[0] + self.w[1])
        z = h @ self.w[2] + self.w[3]
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return a, h, e / e.sum(axis=1, keepdims=True)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """All parts, likeliest first."""
        return np.argsort(-self._forward(x)[2], axis=1, kind="stable").astype(np.int32)


def fit(sample: np.ndarray, parts: int = PARTS, k: int = NEIGHBOURS, recall: float = RECALL, seed: int = 3, asked: np.ndarray | None = None) -> tuple[Router | None, int]:
    """The router and how many parts a query goes to. None for samples too small to cut. asked: queries to measure recall on, else some of the sample are held out."""
    rng = np.random.default_rng(seed)
    if len(sample) < 8 * parts:
        return None, 1
    rows = sample
    if asked is None or not len(asked):
        held = rng.permutation(len(sample))
        asked, rows = sample[held[: len(sample) // 8]], sample[held[len(sample) // 8 :]]
    near = _nearest(rows, rows, k, True)
    part = balanced_parts(near, parts, rng)
    target = np.full((len(rows), parts), 0.01 / parts)
    np.add.at(target, (np.arange(len(rows)), part), 1.0)
    for c in range(near.shape[1]):
        np.add.at(target, (np.arange(len(rows)), part[near[:, c]]), 1.0)
    router = Router(rows, target / target.sum(axis=1, keepdims=True), rng)
    put = router.parts(rows)[:, 0]
    rank = np.argsort(router.parts(asked), axis=1)  # of each part
    found = rank[np.arange(len(asked))[:, None], put[_nearest(asked, rows, k, False)]]
    share = [(found < t).mean() for t in range(1, parts + 1)]
    return router, int(np.argmax(np.array(share) >= recall)) + 1


def _best(dtype: str, k: int):
    """The best of the rows of a bin for each query, over the parts that it asks for."""

    def of(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({"asker": [], "query_id": [], "vec_id": [], "score": []})
        rows = rows.iloc[np.lexsort((rows["vec_id"].to_numpy(), rows["part"].to_numpy()))]
        part, ids, own, v = rows["part"].to_numpy(), rows["vec_id"].to_numpy(), rows["uid"].to_numpy(), unpacked(rows["vector"], dtype)
        here, first = np.unique(part, return_index=True)
        ends = np.r_[first[1:], len(part)]
        uid, name, ask = asked["uid"].to_numpy(), asked["query_id"].to_numpy(), unpacked(asked["vector"], dtype)
        wants = np.stack([asked["to"].map(lambda to, p=p: p in to).to_numpy(bool) for p in here])
        at_own = dict(zip(own.tolist(), range(len(own)), strict=True))
        out = []
        for low in range(0, len(ask), TOGETHER):
            some = ask[low : low + TOGETHER]
            score = np.full((len(some), len(v)), -np.inf)
            for want, a, b in zip(wants[:, low : low + TOGETHER], first, ends, strict=True):
                score[want, a:b] = some[want] @ v[a:b].T
            for q, u in enumerate(uid[low : low + TOGETHER].tolist()):
                if u in at_own:
                    score[q, at_own[u]] = -np.inf
            least = np.partition(score, -k, axis=1)[:, -k] if len(v) > k else np.full(len(some), -np.inf)
            for q, line in enumerate(score):
                at = np.flatnonzero(line >= least[q] - 1e-9 * max(1.0, abs(least[q]))) if np.isfinite(least[q]) else np.flatnonzero(np.isfinite(line))
                exact = (v[at] * some[q]).sum(axis=1)  # in the same order for equal vectors, so copies tie
                top = np.lexsort((ids[at], -exact))[:k]
                out.append((np.full(len(top), uid[low + q]), np.full(len(top), name[low + q]), ids[at[top]], exact[top]))
        return pd.DataFrame(dict(zip(("asker", "query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return of


class Tree:
    """Leaves by router: a part is a leaf, or is cut by a router of its own into several. Rarer lengths (in bytes) have a leaf each, behind the others."""

    def __init__(self, router: Router | None, probes: int, parts: int, length: int, dtype: str, below: dict[int, tuple[Router, int, int]] | None = None, rarer: tuple[int, ...] = ()):
        self.router, self.probes, self.length, self.dtype, self.below = router, probes, length, dtype, below or {}
        ways = np.array([self.below[p][2] if p in self.below else 1 for p in range(parts)])
        self.first = np.r_[0, np.cumsum(ways)]
        self.rarer = {n: int(self.first[-1]) + k for k, n in enumerate(rarer)}

    def leaves(self) -> int:
        return int(self.first[-1]) + len(self.rarer)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return self.router.parts(x) if self.router else np.zeros((len(x), 1), np.int32)

    def _common(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = vectors.map(len).to_numpy(np.int64)
        at = np.flatnonzero(size == self.length)
        return size, at, unpacked(vectors.iloc[at], self.dtype) if len(at) else np.zeros((0, 1))

    def put(self, vectors: pd.Series) -> np.ndarray:
        """The leaf of each vector."""
        size, at, x = self._common(vectors)
        out = np.array([self.rarer.get(int(n), 0) for n in size], np.int32)
        if len(at):
            part = self._parts(x)[:, 0]
            leaf = self.first[part]
            for p in set(part.tolist()) & self.below.keys():
                own = np.flatnonzero(part == p)
                leaf[own] += self.below[p][0].parts(x[own])[:, 0]
            out[at] = leaf
        return out

    def visits(self, vectors: pd.Series, rows_of: np.ndarray, k: int) -> list[np.ndarray]:
        """The leaves that each query goes to: of its likeliest parts the likeliest leaves, and more until they have more than k rows."""
        size, at, x = self._common(vectors)
        out = [np.array([self.rarer[int(n)]] if int(n) in self.rarer else [], np.int32) for n in size]
        if not len(at):
            return out
        parts = self._parts(x)
        inner = {p: self.below[p][0].parts(x) for p in np.unique(parts[:, : self.probes]).tolist() if p in self.below}
        for row, q in enumerate(at):
            mine = np.concatenate([self.first[p] + inner[p][row, : self.below[p][1]] if p in inner else self.first[p : p + 1] for p in parts[row, : self.probes]])
            if rows_of[mine].sum() <= k:
                rest = np.concatenate([np.arange(self.first[p], self.first[p + 1]) for p in parts[row]])
                rest = rest[~np.isin(rest, mine)]
                mine = np.concatenate([mine, rest[: np.searchsorted(rows_of[mine].sum() + np.cumsum(rows_of[rest]), k, "right") + 1]])
            out[q] = mine.astype(np.int32)
        return out


def _bins(rows_of: list[int], common: int, block: int) -> tuple[list[int], list[int], int]:
    """The first bin of each leaf, how many bins it has, and the number of bins. Small leaves share one, but for those of rarer lengths (from `common` on)."""
    leaves = len(rows_of)
    most = min(block, max(1, -(-sum(rows_of) // LEAST_BINS)))
    first, several, now, filled = [0] * leaves, [1] * leaves, 0, 0
    for p, n in enumerate(rows_of):
        if n > block or filled + n > most and filled or p >= common and filled:
            now, filled = now + (filled > 0), 0
        first[p], several[p] = now, max(1, -(-n // block))
        if n > block:
            now += several[p]
        else:
            filled += n
    return first, several, now + 1


def _sampled(base: DataFrame, rows: int, most: int, dtype: str) -> np.ndarray:
    """Distinct vectors, no more than `most`, chosen by their hash."""
    order = F.xxhash64(F.lit(5), "vector")
    few = base.where(F.shiftrightunsigned(order, 12) <= int(min(1.0, 4 * most / max(rows, 1)) * 2**52))
    picked = few.groupBy(order.alias("h")).agg(F.first("vector").alias("vector")).orderBy("h").limit(most).collect()  # bounded by `most`
    return unpacked(pd.Series([bytes(r["vector"]) for r in picked]), dtype) if picked else np.zeros((0, 1))


def _below(base: DataFrame, tree: Tree, sample: np.ndarray, leaf_rows: int, k: int, recall: float) -> dict[int, tuple[Router, int, int]]:
    """For each part with more than twice leaf_rows rows a router, how many of its leaves a query goes to, and how many there are. A task fits one on
    a bounded sample of the part's rows, and measures on vectors of the first sample that go there."""
    held = base.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def part_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield pd.Series(held.value.put(vectors))

    placed = base.withColumn("part", part_of("vector"))
    ways = {r["part"]: min(MOST_PARTS, -(-r["count"] // leaf_rows)) for r in placed.groupBy("part").count().where(F.col("count") > 2 * leaf_rows).collect()}  # a row for each part
    if not ways:
        return {}
    count = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.approx_count_distinct("vector").alias("n")).collect()}
    order = F.xxhash64(F.lit(9), "vector")
    share = F.element_at(F.create_map(*(x for p, w in ways.items() for x in (F.lit(p), F.lit(min(1.0, 2 * SAMPLE * w / max(1, count[p])))))), F.col("part"))
    few = placed.where(F.col("part").isin(*ways) & (F.shiftrightunsigned(order, 12) <= share * float(2**52)))
    distinct = few.groupBy("part", order.alias("h")).agg(F.first("vector").alias("vector"))
    goes = tree.router.parts(sample)[:, : tree.probes]
    asked = base.sparkSession.sparkContext.broadcast((sample, goes))
    dtype = tree.dtype

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        p = int(rows["part"].iloc[0])
        own = unpacked(rows.sort_values("h")["vector"].iloc[: SAMPLE * ways[p]], dtype)
        some, to = asked.value
        router, probes = fit(own, ways[p], k, recall, asked=some[(to == p).any(axis=1)][:2000])
        return pd.DataFrame({"part": [p], "probes": [probes], "router": [pickle.dumps(router)]})

    made = distinct.groupBy("part").applyInPandas(fitted, "part int, probes int, router binary").collect()  # MOST_PARTS rows at most
    routers = {r["part"]: (pickle.loads(r["router"]), r["probes"], ways[r["part"]]) for r in made}
    return {p: x for p, x in routers.items() if x[0] is not None}


def _dealt(kept: DataFrame, asked: DataFrame, size: list[int], common: int, block: int, together: int) -> tuple[DataFrame, DataFrame]:
    """Queries (with the leaves that they visit in the bin) and rows by bin and chunk. Queries of a bin are cut into chunks of about `together`, and
    the bin's rows go to each chunk."""
    first, several, bins = _bins(size, common, block)
    numbers = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")  # noqa: E731  a constant
    begin, stop, ways = numbers(first), numbers([a + n - 1 for a, n in zip(first, several, strict=True)]), numbers(several)
    own = lambda p: F.sequence(F.element_at(begin, p + 1), F.element_at(stop, p + 1))
    left = asked.withColumn("bin", F.explode(F.array_distinct(F.flatten(F.transform("to", own)))))
    left = cut(left.withColumn("to", F.filter("to", lambda p: (F.element_at(begin, p + 1) <= F.col("bin")) & (F.col("bin") <= F.element_at(stop, p + 1)))))
    chunks = [1] * bins
    for r in left.groupBy("bin").count().collect():  # a row for each bin
        chunks[r["bin"]] = max(1, -(-r["count"] // together))
    of_bin = lambda: F.element_at(numbers(chunks), F.col("bin") + 1)
    left = left.withColumn("chunk", F.pmod(F.xxhash64(F.lit("q"), "uid"), of_bin()).cast("int"))
    mine = F.element_at(begin, F.col("leaf") + 1) + F.pmod(F.xxhash64(F.lit("b"), "uid"), F.element_at(ways, F.col("leaf") + 1)).cast("int")
    right = kept.withColumn("bin", mine).select("uid", "vec_id", "vector", F.col("leaf").alias("part"), "bin", F.explode(F.sequence(F.lit(0), of_bin() - 1)).alias("chunk"))
    return left, right


def search(rows: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, parts: int | None = None, recall: float = RECALL, block: int = BLOCK, together: int = QUERIES_A_BLOCK, leaf_rows: int | None = None) -> DataFrame:
    """query_id, rank from 1, vec_id, score. queries: by default the rows whose id is divisible by `every`."""
    dtype = element(rows, vector_col)
    pack = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), packed(F.col(vector_col), dtype).alias("vector")).where("vec_id is not null and vector is not null")
    every_row = cut(pack(rows))
    lengths = every_row.groupBy(F.length("vector").alias("bytes")).count().orderBy(F.desc("count"), "bytes").collect()  # a row for each length
    length, total = (lengths[0]["bytes"], lengths[0]["count"]) if lengths else (0, 0)
    base = every_row.where(F.length("vector") == length)
    leaf_rows = leaf_rows or max(PART_ROWS, int(total**0.5))
    parts = parts or max(PARTS, min(MOST_PARTS, 1 << max(0, total // PART_ROWS).bit_length() - 1 if total >= PART_ROWS else 1))
    deep = total > 2 * leaf_rows * parts
    each = recall**0.5 if deep else recall  # two levels miss neighbours independently
    sample = _sampled(base, total, SAMPLE * parts, dtype)
    router, probes = fit(sample, parts, k, each)
    tree = Tree(router, probes, parts if router else 1, length, dtype)
    below = _below(base, tree, sample, leaf_rows, k, each) if deep and router else {}
    tree = Tree(router, probes, parts if router else 1, length, dtype, below, tuple(r["bytes"] for r in lengths[1:]))
    held = base.sparkSession.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def leaf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield pd.Series(held.value.put(vectors))

    kept = cut(every_row.select("vec_id", "vector", leaf("vector").alias("leaf"), F.monotonically_increasing_id().alias("uid")))
    size = [0] * tree.leaves()
    for r in kept.groupBy("leaf").count().collect():  # a row for each leaf
        size[r["leaf"]] = r["count"]
    rows_of = base.sparkSession.sparkContext.broadcast(np.array(size))

    @F.pandas_udf("array<int>")
    def visits(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in parts:
            yield pd.Series(held.value.visits(vectors, rows_of.value, k), dtype=object)

    if queries is None:
        asked = kept.where(F.col("vec_id") % every == 0).select("uid", F.col("vec_id").alias("query_id"), "vector", visits("vector").alias("to"))
    else:
        asked = pack(queries).select((-1 - F.monotonically_increasing_id()).alias("uid"), F.col("vec_id").alias("query_id"), "vector", visits("vector").alias("to"))
    left, right = _dealt(kept, cut(asked), size, tree.leaves() - len(tree.rarer), block, together)
    key = ["chunk", "bin"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_best(dtype, k), "asker long, query_id long, vec_id long, score double")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_learned_partitions": op5_learned_partitions}
#: None: an approximate index. tests/llm/test_ann.py measures its recall against all pairs.
SQL: dict[str, str] = {}
