"""Large files read by byte ranges: a JSON array in pieces, and the end of a log. Files are opened with pyarrow's file systems, in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a piece, and of what is read at once behind its end.
PIECE, MORE = 64 << 20, 1 << 20
_QUOTE, _BACK, _OPEN, _CLOSE, _COMMA = ord('"'), ord("\\"), (ord("{"), ord("[")), (ord("}"), ord("]")), ord(",")


def _file(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(at)


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Where quotes are that no backslash escapes. before: how many backslashes stand in front of the data."""
    at = np.flatnonzero(data == _QUOTE)
    if not len(at):
        return at
    other = np.flatnonzero(data != _BACK)
    last = np.searchsorted(other, at) - 1  # the last byte before each quote that is no backslash
    run = np.where(last >= 0, at - other[last] - 1, at + before)
    return at[run % 2 == 0]


def _depths(data: np.ndarray, quotes: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it is in a string (its quotes included), and the change of depth."""
    closing = np.zeros(len(data) + 1, np.int8)
    closing[quotes] = 1
    parity = np.cumsum(closing[:-1]) + int(inside)
    quoted = (parity % 2 == 1) | (closing[:-1] == 1)
    change = np.isin(data, _OPEN).astype(np.int8) - np.isin(data, _CLOSE).astype(np.int8)
    return quoted, np.where(quoted, 0, change)


def _backslashes(f, at: int) -> int:
    """How many stand before a place."""
    n = 0
    while at > n:
        take = min(4096, at - n)
        f.seek(at - n - take)
        block = f.read(take)
        rest = len(block) - len(block.rstrip(b"\\"))
        n += rest
        if rest < take:
            break
    return n


def summary(path: str, start: int, end: int) -> tuple[bool, int, int]:
    """Of a piece: whether it has an odd number of quotes, and the change of depth if it begins outside a string, and if inside."""
    with _file(path) as f:
        before = _backslashes(f, start)
        f.seek(start)
        data = np.frombuffer(f.read(end - start), np.uint8)
    quotes = _quotes(data, before)
    return len(quotes) % 2 == 1, *(int(_depths(data, quotes, inside)[1].sum()) for inside in (False, True))


def objects(path: str, start: int, end: int, inside: bool, depth: int, strict: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the array's objects that begin in a piece. strict: anything else in the array is an error."""
    with _file(path) as f:
        before = _backslashes(f, start)
        f.seek(start)
        raw = f.read(end - start)
        while True:
            data = np.frombuffer(raw, np.uint8)
            quoted, change = _depths(data, _quotes(data, before), inside)
            after = depth + np.cumsum(change)
            first = np.flatnonzero((change == 1) & (after == 2) & (data == _OPEN[0]))
            first = first[first < end - start]
            last = np.flatnonzero((change == -1) & (after == 1))
            stop = np.searchsorted(last, first)
            if not len(first) or stop[-1] < len(last):
                break
            more = f.read(MORE)  # the last object ends behind the piece
            if not more:
                raise ValueError(f"{path}: the array does not end")
            raw += more
    if strict:
        own = slice(0, end - start)
        stray = (after[own] - change[own] == 1) & (change[own] != -1) & ~np.isin(data[own], [*b" \t\r\n", _COMMA, _OPEN[0]])
        stray |= (after[own] == 0) & (change[own] == 0) & ~np.isin(data[own], [*b" \t\r\n"])
        if stray.any():
            raise ValueError(f"{path}: the array holds something that is no object, at byte {start + int(np.flatnonzero(stray)[0])}")
    for a, k in zip(first.tolist(), stop.tolist(), strict=True):
        yield start + a, raw[a : int(last[k]) + 1]


def read_array(spark: SparkSession, path: str, schema: str, strict: bool = False, piece: int = PIECE) -> DataFrame:
    """(fields, ord): the objects of a JSON array, ord giving their order (the place in the file). A task reads a piece of the file. Where a piece begins, inside a string or not and how
    deep, follows from a first look at all pieces, of each of which three numbers reach the driver. strict: anything but objects, and a broken object, is an error; else they are left out.
    An empty array has no rows; so has an empty file, unless strict."""
    with _file(path) as f:
        size = f.size()
    if strict and not size:
        raise ValueError(f"{path}: no array")
    spans = spark.range(0, max(1, -(-size // piece)), 1, max(1, -(-size // piece)))

    def looked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            made = [(k, *summary(path, k * piece, min(size, (k + 1) * piece))) for k in rows["id"].tolist()]
            yield pd.DataFrame(made, columns=["id", "odd", "outside", "inside"])

    states, string, depth = {}, False, 0
    for r in spans.mapInPandas(looked, "id long, odd boolean, outside long, inside long").orderBy("id").collect():  # a row for each piece
        states[r["id"]] = (string, depth)
        depth += r["inside"] if string else r["outside"]
        string ^= r["odd"]
    if strict and (string or depth):
        raise ValueError(f"{path}: the array does not end")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in objects(path, k * piece, min(size, (k + 1) * piece), *states[k], strict):
                    rows.append(row)
                    held += len(row[1])
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    found = spans.mapInArrow(read, "ord long, _json string")
    parsed = found.select("ord", F.from_json("_json", schema + ", _broken string", {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("_r"))
    return parsed.where("_r is not null and _r._broken is null").select("_r.*", "ord").drop("_broken")


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()), pa.array([b.decode("utf-8", "replace") for _, b in rows], pa.string())], names=["ord", "_json"])


def last_lines(path: str, count: int = 1, block: int = 64 << 10) -> list[str]:
    """The last lines of a file that are not blank, trimmed, in order. Blocks are read from the end until the lines are whole, so what is read does not grow with the file."""
    with _file(path) as f:
        at, tail = f.size(), b""
        while at:
            take = min(block, at)
            at -= take
            f.seek(at)
            tail = f.read(take) + tail
            lines = [x.strip() for x in tail.split(b"\n")[1 if at else 0 :]]  # the first may have begun before
            if sum(map(bool, lines)) >= count:
                break
        found = [x.strip() for x in tail.split(b"\n")[1 if at else 0 :]]
    return [x.decode("utf-8", "replace") for x in found if x][-count:] if count else []
