"""Token ids of whole texts, found once per distinct chunk: white space and the run of other characters behind it.

The split pattern of the byte-level vocabularies never matches across the start of such a chunk, so the ids of a text are those of its
chunks. Texts with white space outside ASCII, for which that does not hold, are one chunk each.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa

from .textcols import _IS_SPACE, passes, text_buffer

#: Text whose chunks are encoded together, and text that goes to a tokenizer at a time.
ENCODE_BYTES, BLOCK_BYTES = 16 << 20, 1 << 16
#: Bytes from which a piece has the rank queue for itself.
LONG_PIECE = 4096
#: UTF-8 of U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F and U+3000.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def _large_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _gather(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches offsets[r]..offsets[r + 1] of `flat` for each r of `rows`, and their offsets."""
    size = np.diff(offsets)[rows]
    ends = np.cumsum(size)
    return flat[np.arange(size.sum()) + np.repeat(offsets[rows] - (ends - size), size)], np.append(0, ends)


class ChunkEncoder:
    """Ids of text columns. encode_blocks gives, for texts of whole chunks, the flat ids and the byte length of the text of each id's token."""

    def __init__(self, encode_blocks: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode_blocks = encode_blocks

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts of a column, and the offsets of its rows in them."""
        data, offsets = text_buffer(column)
        begin = _IS_SPACE[data]
        begin[1:] &= ~begin[:-1]
        for d in {int(np.searchsorted(offsets, m.start(), side="right")) - 1 for m in _WIDE_SPACE.finditer(data.tobytes())}:
            begin[offsets[d] : offsets[d + 1]] = False
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        coded = _large_binary(data, np.append(starts, len(data))).dictionary_encode()
        flat, at = self._distinct(coded.dictionary)
        ids, ends = _gather(flat, at, coded.indices.to_numpy())
        return ids, ends[np.searchsorted(starts, offsets)]

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct chunks and the chunks' offsets in them. Chunks stand behind each other in blocks where their borders hold there."""
        data, offsets = text_buffer(chunks)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        joins = _IS_SPACE[data[offsets[:-1]]] & ~_IS_SPACE[data[offsets[1:] - 1]]
        order = np.argsort(~joins, kind="stable")
        data, offsets = text_buffer(chunks.take(pa.array(order)))
        plain = int(joins.sum())
        cuts = np.unique(np.append(np.searchsorted(offsets[: plain + 1], np.arange(0, offsets[plain], BLOCK_BYTES)), plain))
        edges = offsets[np.unique(np.concatenate([[0], cuts, np.arange(plain, len(offsets))]))].tolist()
        raw = data.tobytes()
        flat, size = self.encode_blocks([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
        ends = np.append(0, np.cumsum(size))
        if ends[-1] != len(raw):
            raise ValueError("the ids do not stand for the whole text")
        at = np.searchsorted(ends, offsets)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return _gather(flat, at, back)


def encoded_parts(encoder: ChunkEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the ids of their texts."""
    for batch in batches:
        for part in passes(batch, limit=ENCODE_BYTES):
            yield part, *encoder.ids(part.column("text"))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Byte-pair merges in order of rank, from a queue of one bucket per rank under a hierarchical bitmap.

    A bucket is a heap of positions in the linked list of parts, so that equal ranks merge from the left. Bit r of the lowest level says that
    bucket r has entries, a bit above that a 64-bit word below has bits; the lowest set bits from the top down name the next rank. Entries are
    not removed when a merge changes their pair: they are skipped when they come up. A text of n bytes takes O(n log n) steps.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        splits = sorted((ranks[a] << 32 | ranks[b], rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := token[:i]) in ranks and (b := token[i:]) in ranks)
        #: (left, right) of all pairs that join to a token, and that token
        self.pair_keys, self.pair_ranks = (np.array([x[k] for x in splits], np.int64) for k in (0, 1))
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        width, self.levels = max(ranks.values(), default=0) + 1, []
        while not self.levels or width > 1:
            width = (width + 63) // 64
            self.levels.append([0] * width)

    def encode(self, piece: bytes) -> list[int]:
        ranks, levels = self.ranks, self.levels
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        after, before, rank_at = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        buckets: dict[int, list[int]] = {}

        def push(i: int, rank: int) -> None:
            rank_at[i] = rank
            if (bucket := buckets.get(rank)) is not None:
                heappush(bucket, i)
                return
            buckets[rank] = [i]
            for words in levels:
                bit, rank = 1 << (rank & 63), rank >> 6
                old = words[rank]
                words[rank] = old | bit
                if old:
                    break

        get = ranks.get
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                push(i, rank)
        top = levels[-1]
        while top[0]:
            rank = 0
            for words in reversed(levels):
                word = words[rank]
                rank = rank << 6 | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                r = rank
                for words in levels:
                    bit, r = 1 << (r & 63), r >> 6
                    words[r] &= ~bit
                    if words[r]:
                        break
            if rank_at[i] != rank:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            rank_at[gone] = rank_at[i] = -1
            if end < n:
                before[end] = i
                if (rank := get(piece[i : after[end]])) is not None:
                    push(i, rank)
            if (left := before[i]) >= 0:
                if (rank := get(piece[left:end])) is not None:
                    push(left, rank)
                else:
                    rank_at[left] = -1
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : after[i]]])
            i = after[i]
        return ids


    def _mark(self, rank: int) -> None:
        for words in self.levels:
            bit, rank = 1 << (rank & 63), rank >> 6
            old = words[rank]
            words[rank] = old | bit
            if old:
                break

    def _first(self) -> int:
        rank = 0
        for words in reversed(self.levels):
            word = words[rank]
            rank = rank << 6 | ((word & -word).bit_length() - 1)
        return rank

    def _unmark(self, rank: int) -> None:
        for words in self.levels:
            bit, rank = 1 << (rank & 63), rank >> 6
            words[rank] &= ~bit
            if words[rank]:
                break

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair joins to, or -1."""
        if not len(self.pair_keys):
            return np.full(len(left), -1)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def encode_many(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of encode() of each piece and the pieces' offsets, with one queue for all: a bucket's positions merge in one numpy step.

        Within a piece, encode() would turn at once to a new pair of lower rank than the bucket's; a piece in which one appears is encoded
        alone, as are very long ones. Pieces must not be empty.
        """
        data, offsets = text_buffer(pieces)
        size = np.diff(offsets)
        alone = set(np.flatnonzero(size > LONG_PIECE).tolist()) if len(self.pair_keys) else set(range(len(size)))
        last = offsets[1:] - 1
        n = len(data)
        token = self.byte_ids[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last] = -1
        before[offsets[:-1]] = -1
        rank_at = np.full(n, -1)
        buckets: dict[int, list[np.ndarray]] = {}

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            rank_at[at] = ranks
            good = ranks >= 0
            at, ranks = at[good], ranks[good]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(at)]
            for a, b, rank in zip(bounds[:-1], bounds[1:], ranks[[0, *cuts]].tolist(), strict=True):
                if (bucket := buckets.get(rank)) is not None:
                    bucket.append(at[a:b])
                else:
                    buckets[rank] = [at[a:b]]
                    self._mark(rank)

        linked = after >= 0
        for i in alone:
            linked[offsets[i] : offsets[i + 1]] = False
        start = np.flatnonzero(linked)
        push(start, self._joined(token[start], token[start + 1]))
        top = self.levels[-1]
        while top[0]:
            rank = self._first()
            self._unmark(rank)
            bucket = buckets.pop(rank)
            at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            at = at[rank_at[at] == rank]
            if not len(at):
                continue
            gone = after[at]
            if len(at) > 1 and (tied := gone[:-1] == at[1:]).any():
                # of pairs that overlap in a row, the first, third, ... merge
                place = np.arange(len(at))
                head = np.maximum.accumulate(np.where(np.append(False, tied), 0, place))
                odd = (place - head) % 2 == 0
                at, gone = at[odd], gone[odd]
            end = after[gone]
            token[at], token[gone], rank_at[at], rank_at[gone] = rank, -1, -1, -1
            after[at] = end
            inner = end >= 0
            before[end[inner]] = at[inner]
            left = before[at]
            left = left[left >= 0]
            pairs = np.concatenate([at[inner], left])
            if len(pairs):
                new = self._joined(token[pairs], token[after[pairs]])
                if ((new >= 0) & (new < rank)).any():
                    alone.update(np.searchsorted(last, pairs[(new >= 0) & (new < rank)]).tolist())
                push(pairs, new)
        live = np.flatnonzero(token >= 0)
        flat, at = token[live], np.searchsorted(live, offsets)
        if not alone:
            return flat.astype(np.uint32), at
        raw = data.tobytes()
        lists = {i: self.encode(raw[offsets[i] : offsets[i + 1]]) for i in sorted(alone)}
        parts = [np.array(lists[i]) if i in lists else flat[at[i] : at[i + 1]] for i in range(len(size))]
        return np.concatenate(parts).astype(np.uint32), np.append(0, np.cumsum([len(p) for p in parts]))


def rank_encoder(ranks: dict[bytes, int], pattern: str) -> ChunkEncoder:
    """Encodes as the merge ranks say: each match of `pattern` separately, without special tokens."""
    import regex

    pieces, queue = regex.compile(pattern).findall, RankQueue(ranks)
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    length[list(ranks.values())] = [len(token) for token in ranks]

    def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = pa.array([p for t in texts for p in pieces(t.decode())], pa.large_string()).dictionary_encode()
        flat, at = queue.encode_many(coded.dictionary)
        ids, _ = _gather(flat, at, coded.indices.to_numpy())
        return ids, length[ids]

    return ChunkEncoder(blocks)


def library_encoder(path: str) -> ChunkEncoder:
    """Encodes with the tokenizers library; strings of special tokens are ordinary text, and none are added."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    vocabulary = tokenizer.get_vocab()
    # a character of a byte-level token stands for a byte
    length = np.zeros(max(vocabulary.values()) + 1, np.int64)
    length[list(vocabulary.values())] = [len(token) for token in vocabulary]

    def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)])
        return ids, length[ids]

    return ChunkEncoder(blocks)
