"""Passages that repeat byte for byte, by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id. To decide this, suffixes
(up to LENGTH bytes) are sorted one bucket at a time, so that equal ones come together; no task holds the suffixes of the corpus.

Texts are packed into chunks of bounded size and kept, dealt by chunk; later only bits for them are shuffled, never the texts. In each stretch of LENGTH bytes the least hash of its strings of GRAM bytes is its
anchor: equal stretches have the same one, at the same place. Neighbouring stretches share anchors, so a chunk has about one for
thirteen stretches. First only hashes of anchors meet, in buckets by hash, and each chunk learns which of its anchors occur in several documents. Then the
strings around these, and no others, go to the bucket of their anchor, each once for a chunk with the smallest document that has it.

A bucket lays out its distinct strings so that anchors stand at multiples of MODULUS. It ranks the strings of LENGTH - MODULUS + 1 bytes that
start on a difference cover of MODULUS, sorts all suffixes by their first bytes, and settles longer ties by the rank at the next place of the
cover and the few bytes behind it. Anchors line up equal suffixes, so both ends of a tie look at the same place. Equal suffixes take the
smallest document among them, and a bit for each says whether it is a smaller one; only these bits go back.

An anchor with very many surroundings, such as a line that a third of all documents contain, is hot: its stretches travel one by one, dealt
by their own hash, so its bucket does not grow with the corpus. Hashes choose what is compared; bytes decide.

Cases: a null or empty text has no bytes. Documents that share an id are not compared with each other; those without an id lose nothing and
take nothing from others. Equal rows give equal results. Matches never cross documents. Texts of any length are worked through in slabs; a text itself is one row. Only the id
and the text are read, so other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import shared_folder, table

#: Bytes of a string that counts as a repeat, and of those that are hashed for anchors.
LENGTH, GRAM = 50, 24
#: A difference cover: each number below MODULUS is a difference of two of COVER, modulo MODULUS.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Bytes of text in a chunk, stretches in a slab, bytes of text for each bucket.
CHUNK, SLAB, BUCKET = 4 << 20, 1 << 19, 8 << 20
#: An anchor is hot from about so many strings on. The most ways that chunks are dealt to, which Spark bounds.
HOT, MOST_WAYS = 1 << 15, 100_000
_LOW = np.uint64(31)
_B = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64)
#: From each residue the way to the next place of the cover.
_NEXT = np.array([next(d for d in range(MODULUS) if (r + d) % MODULUS in COVER) for r in range(MODULUS)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    back = np.uint64(pow(int(_B), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_B, back))


_UP, _DOWN = _powers(SLAB + LENGTH + 1)


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each string of so many bytes."""
    total = np.r_[np.uint64(0), np.cumsum(_BYTES[data] * _UP[: len(data)], dtype=np.uint64)]
    h = (total[length:] - total[: len(total) - length]) * _DOWN[: len(data) - length + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def runs(data: np.ndarray, sizes: np.ndarray, slab: int = SLAB) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: first stretch, number of stretches, place of the anchor and its hash, for each run of stretches that share an anchor."""
    ends = np.cumsum(sizes)
    out: list[tuple] = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for at in range(0, len(data) - LENGTH + 1, slab):
        piece = data[at : at + slab + LENGTH - 1]
        h = _hashes(piece, GRAM)
        low = h & ~np.uint64((1 << 21) - 1) | np.arange(len(h), dtype=np.uint64)  # the least hash, of equal ones the first
        span, least = 1, low
        wide = LENGTH - GRAM + 1
        while span * 2 <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        inside = np.ones(len(least), bool)
        for e in (ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(least) + LENGTH, "left")] - at).tolist():
            inside[max(0, e - LENGTH + 1) : e] = False  # these would reach into the next text
        some = np.flatnonzero(inside)
        if not len(some):
            continue
        anchor = (least[some] & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        out.append((some[first] + at, np.diff(np.r_[first, len(some)]), anchor[first] + at, h[anchor[first]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Chunk:
    """The texts of a chunk with their runs; anchors (sorted, distinct), which of them each run has, and the bucket of each."""

    def __init__(self, row: dict, buckets: int):
        self.text, self.ids = row["text"], row["ids"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(self.text, np.uint8)
        start, count, place, h = runs(self.data, self.sizes) if len(self.data) >= LENGTH else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        known = np.array([i is not None for i in self.ids], bool)
        doc = np.searchsorted(self.ends, start, "right")
        use = known[doc] if len(doc) else np.zeros(0, bool)
        self.start, self.count, self.lead = start[use], count[use], (place - start)[use]
        self.id = np.array([0 if i is None else i for i in self.ids], np.int64)[doc[use]] if use.any() else np.zeros(0, np.int64)
        self.anchors, self.of = np.unique(h[use] & ~_LOW, return_inverse=True)
        self.buckets = buckets
        self.bucket = (self.anchors >> np.uint64(5)) % np.uint64(buckets)

    def records(self) -> Iterator[tuple[int, bytes]]:
        """For each bucket its anchors, with how often they occur here (a power of two) and whether in several documents in the low bits."""
        often = np.bincount(self.of, minlength=len(self.anchors))
        low, high = np.full(len(self.anchors), np.iinfo(np.int64).max), np.full(len(self.anchors), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, self.id)
        np.maximum.at(high, self.of, self.id)
        record = self.anchors | (np.minimum(15, np.log2(np.maximum(often, 1)).astype(np.uint64)) << np.uint64(1)) | (low < high).astype(np.uint64)
        for b, at in _split(self.bucket):
            yield b, record[at].tobytes()

    def strings(self, flags: list[tuple[int, bytes]]) -> tuple[dict, list]:
        """Distinct strings: bytes to [place in order, smallest id, lead, bucket]; and (string, id, start) for each time that one occurs."""
        repeated, hot = np.zeros(len(self.anchors), bool), np.zeros(len(self.anchors), bool)
        parts = dict(flags)
        for b, at in _split(self.bucket):
            bits = np.unpackbits(np.frombuffer(parts[b], np.uint8).reshape(2, -1), axis=1)[:, : len(at)].astype(bool)
            repeated[at], hot[at] = bits
        found: dict[bytes, list[int]] = {}
        seen = []

        def add(s: bytes, i: int, a: int, lead: int, b: int) -> None:
            old = found.get(s)
            if old is None:
                found[s] = [len(found), i, lead, b]
            elif i < old[1]:
                old[1] = i
            seen.append((s, i, a))

        some = np.flatnonzero(repeated[self.of]) if len(self.of) else []
        text = self.text
        for a, n, lead, i, b, single in zip(*(x[some].tolist() for x in (self.start, self.count, self.lead, self.id)), self.bucket[self.of[some]].tolist(), hot[self.of[some]].tolist(), strict=True) if len(some) else ():
            if single:
                for k in range(a, a + n):
                    s = text[k : k + LENGTH]
                    add(s, i, k, 0, xxhash.xxh3_64_intdigest(s) % self.buckets)
            else:
                add(text[a : a + n + LENGTH - 1], i, a, lead, b)
        return found, seen


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    for b, at in zip(names.tolist(), np.split(order, first[1:]) if len(first) else [], strict=True):
        yield int(b), at


def _by_bucket(found: dict) -> dict[int, list[tuple[bytes, list[int]]]]:
    out: dict[int, list] = {}
    for s, x in found.items():
        out.setdefault(x[3], []).append((s, x))
    return out


def _chunked(size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total, n = [], [], 0, 0
        task = TaskContext.get().partitionId() << 32
        row = lambda: pa.RecordBatch.from_arrays([pa.array([task + n]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())], names=["chunk", "ids", "sizes", "text"])
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py() or b""
                if texts and total + len(t) > size:
                    yield row()
                    ids, texts, total, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(t)
                total += len(t)
        if texts:
            yield row()

    return of


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k].as_py() for c, name in enumerate(batch.schema.names)}


def _recorded(buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            made = list(Chunk(row, buckets).records())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()), pa.array([row["chunk"]] * len(made), pa.int64()), pa.array([r for _, r in made], pa.binary())], names=["bucket", "chunk", "records"])

    return of


def _flagged(hot: int):
    """For each chunk of a bucket two bits for each of its anchors: whether several documents have it, and whether it is hot."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(r, np.uint64) for r in rows["records"]]
        every = np.concatenate(own)
        anchors, which = np.unique(every & ~_LOW, return_inverse=True)
        several = np.bincount(which) > 1
        several[which[(every & np.uint64(1)).astype(bool)]] = True
        often = np.bincount(which, np.exp2((every & _LOW) >> np.uint64(1))) * 1.4 > hot
        cuts = np.cumsum([len(x) for x in own])[:-1]
        bits = [np.packbits(np.stack([several[w], often[w]]), axis=1).tobytes() for w in np.split(which, cuts)]
        return pd.DataFrame({"bucket": rows["bucket"], "chunk": rows["chunk"], "bits": bits})

    return of


def _shipped(buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for row in _rows(batches):
            found, _ = Chunk(row, buckets).strings([(x["bucket"], x["bits"]) for x in row["bits"] or []])
            made = [(b, len(own), pack.compress(np.array([(len(s), x[2], x[1]) for s, x in own], np.int64).T.tobytes() + b"".join(s for s, _ in own))) for b, own in _by_bucket(found).items()]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in made], pa.int64()), pa.array([row["chunk"]] * len(made), pa.int64()), pa.array([n for _, n, _ in made], pa.int64()), pa.array([p for _, _, p in made], pa.binary())], names=["bucket", "chunk", "n", "strings"])

    return of


def cover_ranks(word: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks of the strings of LENGTH - MODULUS + 1 bytes that start at places of the cover; equal strings share one."""
    size = LENGTH - MODULUS + 1
    keys = [word[places + k] for k in (*range(0, size - 8, 8), size - 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def sorted_suffixes(strings: list[bytes], leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of LENGTH bytes or more, sorted: the order, and for each in order whether it differs from the one before (in LENGTH bytes).
    Then the string of each suffix and the first suffix of each string. leads: bytes before each string's anchor."""
    sizes = np.array([len(s) for s in strings], np.int64)
    at = np.zeros(len(strings), np.int64)
    place, parts = 0, []
    for k, (s, lead) in enumerate(zip(strings, leads.tolist(), strict=True)):  # anchors stand at multiples of MODULUS
        gap = -(place + lead) % MODULUS
        parts += [bytes(gap), s]
        at[k] = place + gap
        place += gap + len(s)
    data = b"".join(parts) + bytes(64)
    word = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    count = sizes - LENGTH + 1
    first = np.r_[0, np.cumsum(count)]
    owner = np.repeat(np.arange(len(strings)), count)
    suffix = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(at, count)
    covered = suffix + _NEXT[suffix % MODULUS]
    places, which = np.unique(covered, return_inverse=True)
    rank = cover_ranks(word, places)[which]
    # the bytes that stand before the cover's place and behind its string, beside the rank
    head, near = word[suffix], word[suffix + MODULUS - 8]
    order = np.argsort(head.astype(np.uint64), kind="stable")
    new = np.r_[True, head[order[1:]] != head[order[:-1]]] if len(order) else np.zeros(0, bool)
    tied = ~(new & np.r_[new[1:], True])  # a suffix whose first bytes no other has is in its place
    some = np.flatnonzero(tied)
    if len(some):
        group = np.cumsum(new)[some]
        of = order[some]
        keys = [group, near[of].astype(np.uint64), covered[of] - suffix[of], rank[of], word[suffix[of] + LENGTH - MODULUS + 1].astype(np.uint64), word[suffix[of] + LENGTH - 8].astype(np.uint64)]
        by = np.lexsort(keys[::-1])
        order[some] = of[by]
        differs = np.zeros(len(some), bool)
        for key in keys:
            differs[1:] |= key[by[1:]] != key[by[:-1]]
        differs[0] = True
        new[some] = differs
    return order, new, owner, first


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """For each chunk of a bucket: a bit for each suffix of each of its strings, whether a document with a smaller id has it too."""
    unpack = zstandard.ZstdDecompressor()
    least: dict[bytes, list[int]] = {}
    sent = []
    for n, raw in zip(rows["n"].tolist(), rows["strings"], strict=True):
        raw = unpack.decompress(raw)
        size, lead, ids = np.frombuffer(raw, np.int64, 3 * n).reshape(3, n)
        ends = (24 * n + np.cumsum(size)).tolist()
        own = [raw[b - a : b] for a, b in zip(size.tolist(), ends, strict=True)]
        sent.append((own, ids.tolist()))
        for s, x, i in zip(own, lead.tolist(), ids.tolist(), strict=True):
            old = least.get(s)
            if old is None:
                least[s] = [len(least), i, x]
            elif i < old[1]:
                old[1] = i
    strings = list(least)
    ids, leads = np.array([x[1] for x in least.values()], np.int64), np.array([x[2] for x in least.values()], np.int64)
    order, new, owner, first = sorted_suffixes(strings, leads)
    starts = np.flatnonzero(new)
    smallest = np.minimum.reduceat(ids[owner[order]], starts)
    again = np.zeros(len(order), bool)
    again[order] = smallest[np.cumsum(new) - 1] < ids[owner[order]]
    out = []
    for own, mine in sent:
        bits = []
        for s, i in zip(own, mine, strict=True):
            k, lowest, _ = least[s]
            bits.append(again[first[k] : first[k + 1]] if i == lowest else np.ones(first[k + 1] - first[k], bool))
        out.append(np.packbits(np.concatenate(bits)).tobytes())
    return pd.DataFrame({"bucket": rows["bucket"], "chunk": rows["chunk"], "bits": out})


def _cut_out(buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = Chunk(row, buckets)
            found, seen = chunk.strings([(x["bucket"], x["bits"]) for x in row["bits"] or []])
            settled = {x["bucket"]: x["bits"] for x in row["settled"] or []}
            bits_of: dict[bytes, np.ndarray] = {}
            for b, own in _by_bucket(found).items():
                bits, at = np.unpackbits(np.frombuffer(settled[b], np.uint8)).astype(bool), 0
                for s, _ in own:
                    n = len(s) - LENGTH + 1
                    bits_of[s] = bits[at : at + n]
                    at += n
            hit = np.zeros(len(chunk.data), bool)
            for s, i, a in seen:
                hit[a : a + len(s) - LENGTH + 1] = bits_of[s] if i == found[s][1] else True
            upto = np.cumsum(hit, dtype=np.int32)
            gone = upto > np.r_[np.zeros(min(LENGTH, len(upto)), np.int32), upto[:-LENGTH]] if len(upto) else hit
            spans, kept = [], []
            for a, b in zip((chunk.ends - chunk.sizes).tolist(), chunk.ends.tolist(), strict=True):
                own = gone[a:b]
                if own.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, own, False].view(np.int8))).reshape(-1, 2)
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge])
                    kept.append(chunk.data[a:b][~own].tobytes())
                else:
                    spans.append([])
                    kept.append(chunk.text[a:b])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for at in range(0, len(kept), 500):
                part = slice(at, at + 500)
                yield pa.RecordBatch.from_arrays([pa.array(chunk.ids[part], pa.int64()), pa.array(chunk.sizes[part]), pa.array(spans[part], kinds), pa.array(kept[part], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return of


def _in_place(chunks: DataFrame, at: str, ways: int) -> DataFrame:
    """chunks, kept as a table that is dealt to `ways` by chunk, so that what is joined with them by chunk comes to them and no text is shuffled."""
    spark, name = chunks.sparkSession, f"suffixes_{uuid.uuid4().hex}"
    chunks.write.format("parquet").option("compression", "zstd").option("path", at).bucketBy(ways, "chunk").saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: the files stay
    return kept


def _with(chunks: DataFrame, bits: DataFrame, name: str, ways: int) -> DataFrame:
    """chunks with an array of (bucket, bits) of their own, as many as a chunk has buckets."""
    of = bits.repartition(ways, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
    return chunks.join(of.hint("shuffle_hash"), "chunk", "left")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """One row per row: doc_id, n_bytes, spans (removed runs as byte offsets, end exclusive) and kept (the bytes left)."""
    spark = docs.sparkSession
    at = f"{shared_folder(spark)}/suffixes-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // bucket))
    ways = min(MOST_WAYS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // max(4 * chunk, 1 << 20)))  # with fewer than Spark's own, it would move chunks
    chunks = _in_place(texts.mapInArrow(_chunked(chunk), "chunk long, ids array<long>, sizes array<long>, text binary"), f"{at}/chunks", ways)
    records = chunks.mapInArrow(_recorded(buckets), "bucket long, chunk long, records binary")
    bits = keep(records.groupBy("bucket").applyInPandas(_flagged(hot), "bucket long, chunk long, bits binary"), "anchors")
    known = _with(chunks, bits, "bits", ways)
    sent = known.mapInArrow(_shipped(buckets), "bucket long, chunk long, n long, strings binary")
    settled = keep(sent.groupBy("bucket").applyInPandas(_settled, "bucket long, chunk long, bits binary"), "settled")
    return _with(known, settled, "settled", ways).mapInArrow(_cut_out(buckets), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_suffix_dedup": op11_suffix_dedup}
#: None: SQL would have to make a row for each byte of the corpus. tests/llm/test_suffixes.py compares with sets of strings.
SQL: dict[str, str] = {}
