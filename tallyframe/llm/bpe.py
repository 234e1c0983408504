"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside each partition.

A partition's texts are cut into words by the tokenizer's pattern. Words not met before start as rows (word, position,
byte token); a recursive query joins neighbours with the table of merges and contracts each word's leftmost pair of
lowest rank until none is left. Decoding joins ids with the vocabulary and gathers bytes in order of position.
A word found whole in the vocabulary is that token, as in the library. One contraction a step makes the work grow with
the square of a word's length (0.3 s for one of 1,000 bytes), so words over LONG bytes take the same contractions from a heap instead.

Cases: a null or empty text has no ids. Rows are handled one by one, so repeated ids and rows stay; only the id and the
text are read, so other columns don't matter. A very long text is one row of its batch, with all its ids. An empty table gives an empty
result. The vocabulary file is read on the driver and broadcast: its size is
that of the tokenizer, whatever the corpus.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import table, text_batches

#: Longer words take their merges from a heap.
LONG = 512
#: The sum of squared word lengths that one recursive query takes on, which bounds its rows.
SQUARES = 8_000_000
#: Words whose ids a worker remembers in each of two generations; a word in use moves to the younger one.
REMEMBERED = 400_000

#: A row's own contraction is packed as merged token, position and next position; LONG keeps positions within 10 bits.
ENCODE = """
with recursive steps(word, pos, token, best) as (
  select word, pos, token, min(own) over (partition by word) from (
    select word, pos, token, (m.merged::bigint << 20) | (pos << 10) | next as own
    from (select word, pos, token, lead(token) over w as after, lead(pos) over w as next from pieces window w as (partition by word order by pos))
    left join merges m on m.a = token and m.b = after)
  union all
  select word, pos, token, min(own) over (partition by word) from (
    select word, pos, token, (m.merged::bigint << 20) | (pos << 10) | next as own
    from (
      select word, pos, token, lead(token) over w as after, lead(pos) over w as next from (
        select word, pos, case when pos = ((best >> 10) & 1023) then (best >> 20)::int else token end as token
        from steps where best is not null and pos <> (best & 1023))
      window w as (partition by word order by pos))
    left join merges m on m.a = token and m.b = after)
)
select word, list(token order by pos) as ids from steps where best is null group by word order by word
"""
DECODE = "select doc, list(bytes order by pos) as parts from tokens join vocabulary using (token) group by doc order by doc"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


class Codec:
    def __init__(self, raw: bytes, pattern: str):
        self.ranks = read_ranks(raw)
        self.words = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if self.single.min() < 0:
            raise ValueError("not a byte-level vocabulary: some byte has no token")
        splits = [(self.ranks[t[:i]], self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, merged = (pa.array(x, pa.int32()) for x in zip(*splits, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges, vocabulary = pa.table({"a": a, "b": b, "merged": merged}), pa.table({"token": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("rows", rows)
            self.db.execute(f"create table {name} as select * from rows")
            self.db.unregister("rows")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _contract(self, words: list[bytes]) -> list[bytes]:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(lens) - lens
        pos = np.arange(lens.sum()) - np.repeat(start, lens)
        pieces = pa.table({"word": np.repeat(np.arange(len(words), dtype=np.int32), lens), "pos": pos.astype(np.int32), "token": self.single[np.frombuffer(b"".join(words), np.uint8)]})
        ids = self._query("pieces", pieces, ENCODE)["ids"].combine_chunks()
        flat, ends = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy() * 4
        return [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _contract_long(self, word: bytes) -> bytes:
        ranks, n = self.ranks, len(word)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or end[j] != stop:
                continue
            gone[j], end[i], after[i] = 1, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (r := ranks.get(word[x : end[after[x]]])) is not None:
                    heapq.heappush(heap, (r, x, end[after[x]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Puts the ids of these words among the known ones."""
        todo: list[tuple[str, bytes]] = []
        squares = 0

        def flush() -> None:
            if todo:
                self.known.update(zip([w for w, _ in todo], self._contract([b for _, b in todo]), strict=True))
                todo.clear()

        for w in words:
            b = w.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.known[w] = whole.to_bytes(4, "little")
            elif len(b) > LONG:
                self.known[w] = self._contract_long(b)
            else:
                if squares + len(b) ** 2 > SQUARES:
                    flush()
                    squares = 0
                todo.append((w, b))
                squares += len(b) ** 2
        flush()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [self.words.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = set().union(*cut).difference(self.known)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        self.learn(new - again)
        known = self.known
        return [b"".join([known[w] for w in ws]) for ws in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        lens = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if not len(flat):
            return [b""] * len(ids)
        rows = pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), lens), "pos": np.arange(len(flat)), "token": flat})
        got = self._query("tokens", rows, DECODE)
        parts = got["parts"].combine_chunks()
        if len(parts.values) != len(flat):
            raise ValueError("an id is not in the vocabulary")
        words = parts.values
        data, at = words.buffers()[2].to_pybytes(), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        ends = at[parts.offsets.to_numpy()]
        out = [b""] * len(ids)
        for doc, x, y in zip(got["doc"].to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[doc] = data[x:y]
        return out


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(raw: bytes, pattern: str) -> Codec:
    key = (hash(raw), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read()), pattern


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row: its id, n_tokens, and ids as little-endian unsigned 32-bit integers."""
    raw, cut = _vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(raw.value, cut)
        for rows in batches:
            ids = codec.encode(rows["_text"].tolist())
            yield pd.DataFrame({id_col: rows[id_col], "n_tokens": [len(x) // 4 for x in ids], "ids": ids})
            pa.default_memory_pool().release_unused()  # workers are kept, and would keep what Arrow holds

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return text_batches(docs).select(id_col, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of encode() with the decoded bytes."""
    raw, cut = _vocabulary(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(raw.value, cut)
        for rows in batches:
            rows["decoded"] = codec.decode([x or b"" for x in rows["ids"]])
            yield rows
            pa.default_memory_pool().release_unused()

    return encoded.mapInPandas(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass: two would need a second worker, with a vocabulary of its own, for every task."""
    raw, cut = _vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(raw.value, cut)
        for rows in batches:
            ids = codec.encode(rows["_text"].tolist())
            yield pd.DataFrame({id_col: rows[id_col], "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": codec.decode(ids)})
            pa.default_memory_pool().release_unused()

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return text_batches(docs).select(id_col, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(table(spark, sf_dir, "documents"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
#: None: merges follow a file that is no table. tests/llm/test_bpe.py compares with the library.
SQL: dict[str, str] = {}
