"""Words of Arrow text columns as flat numpy arrays, and helpers for Arrow-batched operators.

A word is a maximal run of bytes other than space and \\x09-\\x0D; in UTF-8 that is the same as a run of such characters.
Null texts count as empty everywhere.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy pass works on; a longer document makes a pass of its own.
PASS_BYTES = 4 << 20

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


class Words(NamedTuple):
    """Words of consecutive texts: `values` is a binary array, document d owns words doc_offsets[d]..doc_offsets[d+1]."""

    values: pa.Array
    doc_offsets: np.ndarray
    starts: np.ndarray  #: byte offset of each word in the joined texts
    text_offsets: np.ndarray  #: byte offset of each document there

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_offsets) - 1), np.diff(self.doc_offsets))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows in them; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~_IS_SPACE[data]
    edge = np.empty(len(data), bool)
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    edge[:1], edge[1:] = True, ~solid[:-1]
    edge[borders] = True
    starts = np.flatnonzero(solid & edge)
    edge[-1:], edge[:-1] = True, ~solid[1:]
    edge[borders - 1] = True
    sizes = np.flatnonzero(solid & edge) + 1 - starts
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(data[solid])])
    return Words(values, np.searchsorted(starts, offsets), starts, offsets)


def joined_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): all words with one space behind each, and where each word begins and ends there."""
    n = len(words.values)
    at = np.frombuffer(words.values.buffers()[1], np.int64)[: n + 1]
    start, end = at[:-1] + np.arange(n), at[1:] + np.arange(n)
    joined = np.full(int(at[-1]) + n, 32, np.uint8)
    letters = np.ones(len(joined), bool)
    letters[end] = False
    if n:
        joined[letters] = np.frombuffer(words.values.buffers()[2], np.uint8)[: at[-1]]
    return joined, start, end


def words_of(column: pa.Array) -> Words:
    return split_words(*text_buffer(column))


def passes(batch: pa.RecordBatch, text: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(batches: Iterator[pa.RecordBatch], key: str, least_rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables that hold whole groups of equal `key`, from batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).combine_chunks().to_numpy(zero_copy_only=False)
        cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def prepare_workers(spark: SparkSession) -> None:
    """Settings for this session's Python workers, which live from task to task; what is set already stays.

    They import the package from where the driver has it (a cluster installs it or gets --py-files), and give freed arrays back to the system
    instead of keeping the memory of their largest task.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (have := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "16000000"), ("MALLOC_TRIM_THRESHOLD_", "64000000"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)


#: Folders that this process has written with stored() and not yet released.
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share; set here only where it is unset and Spark runs locally."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}/eventloom-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later jobs don't repeat its work, and a lost executor loses none of it.

    The folder stays until release() is called, as what is read may be used at any later time.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that stored() has written; nothing that reads them may be needed any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        WRITTEN.remove(path)
