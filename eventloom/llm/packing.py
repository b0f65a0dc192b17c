"""Packing of token ids into sequences of bounded length: bounded-space online best fit, with a merge of what stays open."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import prepare_workers, stored
from .tokens import ChunkEncoder, encoded_parts, library_encoder

LENGTH, END_ID = 2048, 1
#: Windows that a partition keeps open, and the smallest gap that is filled with the head of a piece that fits nowhere.
OPEN, LEAST_CUT = 32, 16
#: Open windows of all partitions that one task merges.
MERGE_ROWS = 8192
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(1)
def _encoder(path: str) -> ChunkEncoder:
    return library_encoder(path)


class _Windows:
    """The open windows of a partition: (room, number) sorted by room, and the pieces in each."""

    def __init__(self, first: int, length: int, most: int):
        self.next, self.length, self.most = first, length, most
        self.room: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}

    def _put(self, number: int, room: int, piece: tuple, size: int) -> list[tuple]:
        """Puts a piece into a window; the window's pieces if that fills it."""
        self.held[number].append((*piece, number, self.length - room))
        if room > size:
            insort(self.room, (room - size, number))
            return []
        return self.held.pop(number)

    def add(self, doc: int, start: int, size: int, cut) -> list[tuple]:
        """Places `size` tokens of a document; the pieces of windows that this closes. cut(start, size) gives a piece's fields."""
        out: list[tuple] = []
        while size:
            if size < self.length and (at := bisect_left(self.room, (size, -1))) < len(self.room):
                room, number = self.room.pop(at)
                return out + self._put(number, room, cut(start, size), size)
            if size < self.length and len(self.room) == self.most:
                room, number = self.room.pop(0)
                if room >= LEAST_CUT:
                    out += self._put(number, room, cut(start, room), room)
                    start, size = start + room, size - room
                    continue
                out += self.held.pop(number)
            number, self.next = self.next, self.next + 1
            self.held[number] = []
            part = min(size, self.length)
            out += self._put(number, self.length, cut(start, part), part)
            start, size = start + part, size - part
        return out


def packed(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, open_windows: int = OPEN) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every document of `docs` (doc_id, text).

    A document is its ids and `end_id`; null texts have that one. Full stretches of `length` become sequences at once; the rest goes to the open
    window that it fills best. Where none has room, the fullest is topped up with the head of the piece and closed. What partitions leave open is
    merged at the end, whole windows at a time. Sequences are padded to `length`; that those of a power of two need not be is made no use of. Ids
    of sequences are unique, not consecutive; texts of any length are encoded whole, repeated rows are packed each, other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_workers(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        windows = _Windows(TaskContext.get().partitionId() << 33, length, open_windows)
        for part, ids, offsets in encoded_parts(encoder, batches):
            ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
            offsets = offsets + np.arange(len(offsets))
            raw, done = memoryview(ids.tobytes()), []
            for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                done += windows.add(doc, 0, b - a, lambda s, n, doc=doc, a=a, b=b: (doc, s, n, zlib.crc32(raw[4 * (a + s) : 4 * (a + s + n)]), b - a))
            yield table(done, False)
        yield table([p for held in windows.held.values() for p in held], True)

    def table(pieces: list[tuple], left: bool) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([left] * len(pieces), pa.bool_())], [*_names, "left"])

    _names = [c.split()[0] for c in _PIECES.split(", ")]
    pieces = stored(docs.select("doc_id", "text").mapInArrow(rows, f"{_PIECES}, left boolean"))
    left = pieces.where("left")
    fills = left.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    count = fills.count()
    moved = stored(fills.repartition(max(1, math.ceil(count / MERGE_ROWS)), "sequence_id").mapInArrow(_merge(length), "sequence_id long, into long, base long"))
    merged = left.join(moved, "sequence_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("into").alias("sequence_id"), (F.col("offset") + F.col("base")).alias("offset"))
    return pieces.where("NOT left").drop("left").unionByName(merged)


def _merge(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = sorted((-f, s) for b in batches for s, f in zip(b.column("sequence_id").to_pylist(), b.column("fill").to_pylist(), strict=True))
        room: list[tuple[int, int]] = []
        out = []
        for fill, number in windows:
            if (at := bisect_left(room, (-fill, -1))) < len(room):
                have, into = room.pop(at)
            else:
                have, into = length, number
            out.append((number, into, length - have))
            insort(room, (have + fill, into))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * 3)], ["sequence_id", "into", "base"])

    return rows
