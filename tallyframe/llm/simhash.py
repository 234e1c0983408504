"""SimHash near-duplicates, with candidates from pigeonring chains.

A 64-bit fingerprint is cut into a ring of b + 1 segments of nearly equal width. If two fingerprints differ in at most b
bits, then there is a segment from which the differences summed over 1, 2, 3, ... consecutive segments stay within
0, 1, 2, ..., a proportional share of the budget each (strong form of the pigeonhole principle). So two fingerprints meet
in the bucket of a segment in which they agree, or, in large tables, of two consecutive segments that agree but for one bit: the second
is posted with each of its bits left out in turn. In a bucket a pair is dropped as soon as its chain goes over its
budget; the chain over the whole ring is the full Hamming check. Either kind of bucket gives the same links.

near_duplicates() links fingerprints of three-word shingles within three bits. similar() links texts by the similarity of
their sets of five-word shingles: fingerprints of two-word shingles, which five-word edits move least, give candidates within
nine bits (and of sizes that the similarity allows), and the sets themselves are compared within groups of
candidates, in blocks, leaving out pairs that are already connected.

Cases: a null or empty text, and one of white space only, has fingerprint zero and is linked like any other. Fewer
words than a shingle has: the whole sequence is one shingle. Equal fingerprints, or texts, are one node, so copies are never
paired. A very long text is one row of its task. An empty table gives an empty result. A null id never becomes a component's id unless all
ids in it are null. Only id and text are read where links are sought, and keep_first nests the input's columns, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded, by_component, components, cut, forest, nested, table, text_batches

SEED = 42
RING = 64
#: Fingerprints that a bucket of one segment should have on average at most; beyond, buckets are of two segments.
MEAN_BUCKET = 2048
#: What similar() takes unless told otherwise.
SIMILARITY, SHINGLE, CANDIDATE_WORDS, CANDIDATE_BITS = 0.8, 5, 2, 9
#: Texts whose sets meet in one comparison.
SETS = 128
#: Fingerprints of a bucket that are compared at once; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_COLUMN = 256 * np.arange(8)


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned integer."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        whole = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = [0, *(ends[: len(found) - words] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return _majority(np.array(hashes, dtype="<u8"))


def _majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes."""
    parts = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.bincount((parts + _COLUMN).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, words: int = 3) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return of(text)


def ring(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shift and width of each of bits + 1 segments."""
    if not 0 <= bits < 32:
        raise ValueError("bits must be from 0 to 31")
    edge = np.arange(bits + 2) * RING // (bits + 1)
    return edge[:-1], np.diff(edge)


def _chains(diff: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Which of the differences stay within the budgets of the chain that starts at segment first."""
    shift, width = ring(bits)
    mask = (np.uint64(1) << width.astype(np.uint64)) - np.uint64(1) if bits else np.array([2**64 - 1], np.uint64)
    left, total = np.arange(len(diff)), np.zeros(len(diff), np.int64)
    for length in range(1, bits + 2):
        at = (first[left] + length - 1) % (bits + 1)
        total = total + np.bitwise_count((diff[left] >> shift[at].astype(np.uint64)) & mask[at])
        stay = total <= length * bits // (bits + 1)
        left, total = left[stay], total[stay]
    within = np.zeros(len(diff), bool)
    within[left] = True
    return within


def _grouped(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows that arrive sorted by names, cut so that no group is torn, with the bounds of their groups."""
    rest = None
    for last, batch in _ahead(batches):
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(rows):
            continue
        key = rows[names].to_numpy()
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        rest = None
        if not last:
            rest, rows, new = rows.iloc[new[-1] :], rows.iloc[: new[-1]], new[:-1]
        if len(rows):
            yield rows, np.r_[new, len(rows)]


def _linked(bits: int):
    """Links within buckets that arrive sorted, as a spanning forest of each: never more rows than came in."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bound in _grouped(batches, ["seg", "part", "x", "y"]):
            yield _edges(rows, bound, bits)

    return of


def _ahead(items: Iterator) -> Iterator:
    held = []
    for x in items:
        if held:
            yield False, held.pop()
        held.append(x)
    for x in held:
        yield True, x


def _edges(rows: pd.DataFrame, bound: np.ndarray, bits: int) -> pd.DataFrame:
    fp, seg, node = rows["fp"].to_numpy().view(np.uint64), rows["seg"].to_numpy() // RING, rows["node"].to_numpy()
    size = np.diff(bound)
    group = np.repeat(np.arange(len(size)), size)
    left, right = [], []
    at, step = np.flatnonzero((size > 1)[group] & (size <= 48)[group]), 1
    while len(at := at[(at + step < len(fp))]) and len(at := at[group[at] == group[np.minimum(at + step, len(fp) - 1)]]):
        hit = at[_chains(fp[at] ^ fp[at + step], seg[at], bits)]
        left.append(hit)
        right.append(hit + step)
        step += 1
    shift, width = ring(bits)
    for g in np.flatnonzero(size > 48):
        low, high = bound[g], bound[g + 1]
        second = (seg[low] + 1) % (bits + 1)  # a look at the second segment leaves few pairs
        near = fp[low:high] >> np.uint64(shift[second]) & np.uint64(2 ** int(width[second]) - 1)
        near = near.astype(np.uint16 if width[second] <= 16 else np.uint64)
        i, j = np.nonzero(np.triu(np.bitwise_count(near[:, None] ^ near) <= 2 * bits // (bits + 1), 1))
        hit = _chains(fp[low + i] ^ fp[low + j], np.full(len(i), seg[low]), bits)
        left.append(low + i[hit])
        right.append(low + j[hit])
    label = forest(len(fp), np.concatenate([*left, []]).astype(int), np.concatenate([*right, []]).astype(int))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return pd.DataFrame({"src": node[own], "dst": node[label[own]]})


def _dealt(posts: DataFrame, key: list[str], block: int) -> DataFrame:
    """posts (with node and key) with x and y: a bucket of over `block` rows becomes pairs of blocks x <= y, and a row goes to all of its block's."""
    big = cut(posts.groupBy(*key).count().where(F.col("count") > block))
    return (
        posts.join(bounded(big), key, "left")
        .withColumn("n", F.coalesce(F.ceil(F.col("count") / block), F.lit(1)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(*(c for c in posts.columns), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    )


def links(nodes: DataFrame, bits: int = 3, block: int = BLOCK, segments: int | None = None) -> DataFrame:
    """(src, dst) links that connect the nodes (node, fp and, if there is one, band) exactly as all pairs within so many bits would,
    of bands at most one apart. segments: 1 or 2, how many a bucket is made of; by default as the number of nodes asks for."""
    shift, width = ring(bits)
    banded = "band" in nodes.columns
    if segments is None:
        segments = 1 if bits == 0 or nodes.count() <= MEAN_BUCKET * 2 ** int(width.min()) * (8 if banded else 1) else 2
    segment = lambda s: F.shiftrightunsigned("fp", int(shift[s])).bitwiseAND(2 ** int(width[s]) - 1) if bits else F.col("fp")
    post = lambda s, j, part: F.struct(F.lit(s * RING + j).alias("seg"), part.alias("part"))
    if segments == 1:
        posts = [post(s, 0, segment(s)) for s in range(bits + 1)]
    else:
        after = lambda s: (s + 1) % (bits + 1)
        posts = [post(s, j, F.shiftleft(segment(after(s)).bitwiseAND(2 ** int(width[after(s)]) - 1 - 2**j), int(width[s])) + segment(s)) for s in range(bits + 1) for j in range(width[after(s)])]
    made = nodes.select("node", "fp", *(["band"] if banded else []), F.explode(F.array(*posts)).alias("p")).select("node", "fp", "p.seg", "p.part", *(["band"] if banded else []))
    if banded:  # a row stands in its own band's bucket and in the next one's
        made = made.select("node", "fp", "seg", F.explode(F.array("band", F.col("band") + 1)).alias("band"), "part").select("node", "fp", "seg", (F.shiftleft("part", 12) + F.col("band")).alias("part"))
    dealt = _dealt(made, ["seg", "part"], block)
    return dealt.repartition("seg", "part", "x", "y").sortWithinPartitions("seg", "part", "x", "y", "fp").mapInPandas(_linked(bits), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 3, words: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest id reachable by links, its own included)."""
    own = cut(text_batches(docs).select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct.select(F.col("fp").alias("node"), "fp"), bits)).withColumnRenamed("node", "fp")
    linked = distinct.join(found, "fp")
    first = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = by_component(linked, first).select("fp", "component_id")
    of_fp = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))  # so that the join can split a fingerprint's documents
    return own.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def thinned(edges: DataFrame) -> DataFrame:
    """Links (src, dst) that connect the same nodes: each src with its smallest dst, and that one with the others. Where many nodes have the same few dst, as the members of a large group do whose
    buckets or blocks overlap, the latter are the same for all of them, and about one link for each node is left. A src has no more dst than buckets, or blocks of one."""
    stars = cut(edges.groupBy("src").agg(F.min("dst").alias("root"), F.sort_array(F.collect_set("dst")).alias("others")))
    among = stars.where(F.size("others") > 1).select("root", "others").distinct().select(F.explode("others").alias("src"), F.col("root").alias("dst"))
    return stars.select("src", F.col("root").alias("dst")).unionByName(among).where("src <> dst").distinct()


# ---- similarity of shingle sets


class Shingles:
    """Hashes of a text's shingles, from hashes of its words."""

    def __init__(self, remembered: int = 500_000):
        self.known: dict[bytes, int] = {}
        self.remembered = remembered

    def words(self, text: str | None) -> np.ndarray:
        found, known = (text or "").encode("utf-8", "surrogatepass").lower().split(), self.known
        if len(known) > self.remembered:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def of(words: np.ndarray, length: int) -> np.ndarray:
        """One hash for each shingle, repeats included; the whole sequence if it is shorter, nothing if there are no words."""
        n = len(words)
        length = min(length, n)
        out = np.full(n - length + 1 if n else 0, 0x9E3779B97F4A7C15, np.uint64)
        for k in range(length if n else 0):
            out = (out ^ words[k : n - length + 1 + k]) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        out = out * np.uint64(0x94D049BB133111EB)
        return out ^ out >> np.uint64(31)


def _nodes_of(texts: Column, words: int, shingle: int) -> Column:
    """(fp, size): the fingerprint of shingles of `words`, and how many different ones of `shingle` words there are."""

    @F.pandas_udf("fp long, size long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = Shingles()
        for part in parts:
            found = [made.words(t) for t in part]
            fp = np.array([_majority(made.of(w, words)) if len(w) else 0 for w in found], np.uint64).view(np.int64)
            yield pd.DataFrame({"fp": fp, "size": np.array([len(np.unique(made.of(w, shingle))) for w in found], np.int64)})

    return of(texts)


def _compared(bits: int, similarity: float):
    """Links of enough similarity within groups that arrive sorted, as a spanning forest of each."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, bound in _grouped(batches, ["component", "x", "y"]):
            fp, node, held = rows["fp"].to_numpy().view(np.uint64), rows["node"].to_numpy(), rows["shingles"].tolist()
            src, dst = [], []
            for low, high in zip(bound[:-1], bound[1:], strict=True):
                sets = [np.frombuffer(x, "<u8") for x in held[low:high]]
                size = np.array(list(map(len, sets)))
                near = np.bitwise_count(fp[low:high, None] ^ fp[None, low:high]) <= bits
                near &= np.minimum(size[:, None], size) >= similarity * np.maximum(size[:, None], size)
                root = list(range(high - low))

                def top(k: int, root: list[int] = root) -> int:
                    while root[k] != k:
                        root[k] = root[root[k]]
                        k = root[k]
                    return k

                for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                    a, b = top(i), top(j)
                    if a != b:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if both >= similarity * (size[i] + size[j] - both):
                            root[max(a, b)] = min(a, b)
                root = [top(k) for k in range(high - low)]
                own = [k for k, r in enumerate(root) if r != k]
                src += node[low:high][own].tolist()
                dst += node[low:high][[root[k] for k in own]].tolist()  # the same root from all of a group, so that links of overlapping groups agree
            yield pd.DataFrame({"src": np.array(src, np.int64), "dst": np.array(dst, np.int64)})

    return of


def _digests(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(1), text).alias("h1")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, words: int = CANDIDATE_WORDS, bits: int = CANDIDATE_BITS, sets: int = SETS, segments: int | None = None) -> DataFrame:
    """One row per different text: h0 and h1 (its digest), first (its smallest id), component_id (the smallest id reachable by links) and
    stays (whether it is the component's text of that id). Two texts are linked if their sets of shingles have at least the
    similarity (Jaccard) and their fingerprints are within so many bits."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    digest = _digests(F.col(text_col))
    own = text_batches(docs).select(F.col(id_col).alias("doc_id"), *digest, _nodes_of(F.col(text_col), words, shingle).alias("f")).select("doc_id", "h0", "h1", "f.fp", "f.size")
    nodes = own.groupBy("h0", "h1").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("size").alias("size"))
    band = F.when(F.col("size") > 0, F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / F.lit(float(-np.log(similarity)) * (1 + 1e-9) or 1e9)) + 1).otherwise(0).cast("int")
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("band", band))
    groups = cut(components(thinned(links(nodes.select("node", "fp", "band"), bits, segments=segments))))
    wanted = cut(nodes.select("node", "h0", "h1", "fp").join(groups, "node"))

    @F.pandas_udf("binary")
    def shingles(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Shingles()
        for part in parts:
            yield pd.Series([np.unique(made.of(made.words(t), shingle)).astype("<u8").tobytes() for t in part], dtype=object)

    texts = docs.select(F.col(text_col).alias("text"), *digest).join(bounded(wanted), ["h0", "h1"])
    found = cut(texts.select("node", "fp", "component", shingles(F.col("text")).alias("shingles")).groupBy("node", "fp", "component").agg(F.first("shingles").alias("shingles")))
    dealt = _dealt(found, ["component"], sets).repartition("component", "x", "y").sortWithinPartitions("component", "x", "y", "node")
    group = components(thinned(dealt.mapInPandas(_compared(bits, similarity), "src long, dst long")))
    linked = nodes.select("node", "h0", "h1", "first").join(group, "node")
    least = linked.groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), "first", "h0", "h1")).alias("least"))
    stays = (F.col("h0") == F.col("least.h0")) & (F.col("h1") == F.col("least.h1"))
    named = by_component(linked, least).select("node", F.struct(F.col("least.first").alias("first"), stays.alias("stays")).alias("of"))
    joined = nodes.select("node", "h0", "h1", "first").join(named, "node", "left")
    single = F.col("of").isNull()
    return joined.select("h0", "h1", "first", F.when(single, F.col("first")).otherwise(F.col("of.first")).alias("component_id"), F.when(single, F.lit(True)).otherwise(F.col("of.stays")).alias("stays"))


def keep_first(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each component of similar(): the row of the smallest id, among rows of this id the one
    of the smallest digest; of rows with equal id and text the one with the smallest hash. Rows with null ids all stay."""
    stay = found.where("stays and first is not null").select("h0", "h1", "first")
    rows = docs.where(F.col(id_col).isNotNull()).select(nested(docs), F.col(id_col).alias("first"), *_digests(F.col(text_col)))
    kept = rows.join(stay, ["h0", "h1", "first"], "left_semi").groupBy("h0", "h1", "first").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
SQL: dict[str, str] = {}
