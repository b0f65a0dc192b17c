"""Byte-level BPE encoding and decoding of text columns by a file of merge ranks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcols import prepare_workers
from .tokens import ChunkEncoder, encoded_parts, load_ranks, rank_encoder


@lru_cache(2)
def _tools(path: str, pattern: str) -> tuple[ChunkEncoder, dict[int, bytes]]:
    ranks = load_ranks(path)
    return rank_encoder(ranks, pattern), {i: token for token, i in ranks.items()}


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of each whole text (array of int); null texts are empty. `path` must be readable on every worker."""
    prepare_workers(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _tools(path, pattern)
        for part, ids, offsets in encoded_parts(encoder, batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(encodings: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that `ids` stand for; null ids are empty, an id outside the file is an error."""
    prepare_workers(encodings.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, tokens = _tools(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([b"".join(tokens[i] for i in ids or ()) for ids in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encodings.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, encoded and decoded in one pass.

    Null and empty texts have no ids, texts of any length are encoded whole, repeated rows each get their row, and other columns are ignored.
    `pattern` is one of the byte-level kind, whose matches never go on from a sign to white space (see tokens).
    """
    prepare_workers(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = _tools(path, pattern)
        for part, ids, offsets in encoded_parts(encoder, batches):
            ids, n, coded, back = ids.astype("<u4"), np.diff(offsets), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = ids[a:b]
                coded.append(hashlib.sha256(own.tobytes()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(tokens.__getitem__, own.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
