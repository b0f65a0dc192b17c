"""Exact removal of word windows that an earlier document already has, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcols import Words, joined_words, prepare_workers, runs, split_words, stored, text_buffer

#: Words of a window, and of the runs inside it among which the one with the smallest hash is its minimiser.
WINDOW, SUB = 13, 3
#: Text that one batch of documents holds, and text of super-k-mers that one bucket is meant to hold.
BATCH_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Buckets that one task deals with at most, whatever spark.sql.shuffle.partitions says.
TASK_BUCKETS = 32
#: A minimiser is frequent if it has this share of all pieces or, with few buckets, a quarter of a bucket's; its windows travel each alone, by a
#: hash of all their words. So at most 2 / FREQUENT minimisers are broadcast.
FREQUENT = 1e-4
#: A task deals out to this many buckets at a time; more buckets are reached in several levels, so that packed pieces stay large.
FAN_OUT = 1024


def _pack(table: pa.Table | pa.RecordBatch, level: int = 6) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as writer:
        writer.write(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


class _Pieces:
    """The super-k-mers of consecutive documents: maximal runs of windows of a document whose minimiser is the same.

    Windows of the minimisers in `frequent` (sorted) are keyed by all their words instead, which makes each a piece of its own.
    """

    def __init__(self, text: pa.Array, frequent: np.ndarray):
        self.words: Words = (words := split_words(*text_buffer(text)))
        n, at = len(words.values), words.doc_offsets
        #: word i is joined[start[i]:end[i]]; one space stands behind each word
        self.joined, self.start, self.end = joined_words(words)
        count = np.diff(at)
        windows = np.maximum(count - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(count)), windows)
        first = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + at[self.doc]
        if not len(first):
            self.first, self.length, self.mini = first, first, np.zeros(0, np.uint64)
            return
        coded = words.values.dictionary_encode()
        own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[coded.indices.to_numpy()]
        least = own[: n - SUB + 1].copy()
        for k in range(1, SUB):
            least = (least ^ (least >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + own[k : n - SUB + 1 + k]
        least = (least ^ (least >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        least ^= least >> np.uint64(31)
        wide, width = WINDOW - SUB + 1, 1
        while width < wide:
            step = min(width, wide - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        # smallest hashes crowd near zero, and buckets are ranges of the key: mixed once more, keys are even again
        mini = least[first] * np.uint64(0xFF51AFD7ED558CCD)
        mini ^= mini >> np.uint64(33)
        if len(frequent):
            alone = np.flatnonzero(frequent[np.minimum(np.searchsorted(frequent, mini), len(frequent) - 1)] == mini)
            whole = np.zeros(len(alone), np.uint64)
            for k in range(WINDOW):
                whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + own[first[alone] + k]
            mini[alone] = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        new = np.flatnonzero((np.diff(self.doc, prepend=-1) != 0) | np.append(True, mini[1:] != mini[:-1]))
        #: first word, number of windows, minimiser and document of each piece
        self.first, self.length, self.mini, self.doc = first[new], np.diff(np.append(new, len(first))), mini[new], self.doc[new]

    def distinct(self) -> tuple[np.ndarray, pa.Array]:
        """For each piece its number among the distinct packed strings, and those."""
        raw, last = self.joined.tobytes(), self.first + self.length + WINDOW - 2
        packed = pa.array([raw[a:b] for a, b in zip(self.start[self.first].tolist(), self.end[last].tolist(), strict=True)], pa.large_binary())
        coded = packed.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, part, packed): consecutive documents with about BATCH_BYTES of text, packed with all their columns, under a number of their own.

    The numbers are given once, when these rows are stored. All later steps read them there, so answers find their batch whatever the order is
    in which anything is read.
    """
    held, size, number = [], 0, TaskContext.get().partitionId() << 32

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([-1], pa.int64()), pa.array([_pack(pa.Table.from_batches(held).combine_chunks(), 9)], pa.binary())], ["batch", "part", "packed"])

    for batch in batches:
        ends, at = text_buffer(batch.column("text"))[1], 0
        while at < batch.num_rows:
            to = min(int(np.searchsorted(ends, ends[at] + BATCH_BYTES - size)), batch.num_rows)
            held.append(batch.slice(at, to - at))
            size += int(ends[to] - ends[at])
            at = to
            if size >= BATCH_BYTES:
                yield row()
                held, size, number = [], 0, number + 1
    if held:
        yield row()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for number, packed in zip(batch.column("batch"), batch.column("packed"), strict=True):
            yield number.as_py(), _unpack(packed.as_buffer())


def _ids(table: pa.Table) -> np.ndarray:
    """Document ids; rows without one come after all others, so nothing is removed on their account."""
    return table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()


def _deal(number: int, table: pa.Table, level: int, levels: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows of a table of pieces by the bucket of their minimiser at this level."""
    mini = table.column("mini").combine_chunks().to_numpy()
    bucket = (mini.astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)
    bucket = bucket // np.uint64(FAN_OUT ** (levels - 1 - level))
    order = np.argsort(bucket, kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(1 << 63)) != 0), len(order))
    table = table.take(pa.array(order))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[order[a]])], pa.int64()), pa.array([number], pa.int64()), pa.array([_pack(table.slice(a, b - a))], pa.binary())], ["bucket", "number", "packed"])


def _shared_windows(table: pa.Table) -> pa.Table | None:
    """Of pieces (batch, place, mini, words, least, more): for each whose batch must remove something, the smallest id that has each window.

    A piece's batch has its words under ids from least to least + more.
    """
    mini, least, more = (table.column(c).combine_chunks().to_numpy() for c in ("mini", "least", "more"))
    most = least + more
    order = np.argsort(mini, kind="stable")
    new = np.flatnonzero(np.append(True, mini[order][1:] != mini[order][:-1]))
    group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    several = np.minimum.reduceat(least[order], new) < np.maximum.reduceat(most[order], new)
    rows = order[several[group]]
    if not len(rows):
        return None
    table, least, most = table.take(pa.array(rows)), least[rows], most[rows]
    words = split_words(*text_buffer(table.column("words").combine_chunks()))
    code, at = words.values.dictionary_encode().indices.to_numpy().astype(np.int64), words.doc_offsets
    span = 1
    # equal windows get equal numbers by sorting pairs of the numbers of shorter ones
    while span < WINDOW:
        step = min(span, WINDOW - span)
        code = np.unique(code[:-step] * (code.max() + 1) + code[step:], return_inverse=True)[1]
        span += step
    windows = np.diff(at) - WINDOW + 1
    piece = np.repeat(np.arange(len(rows)), windows)
    code = code[np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + at[piece]]
    smallest = np.full(code.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, code, least[piece])
    smallest = smallest[code]
    bounds = np.cumsum(windows) - windows
    wanted = np.minimum.reduceat(smallest, bounds) < most
    if not wanted.any():
        return None
    lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(windows[wanted])), smallest[np.repeat(wanted, windows)])
    return pa.table({"batch": table.column("batch").filter(wanted), "place": table.column("place").filter(wanted), "smallest": lists})


def _flags(pieces: _Pieces, kind: np.ndarray, ids: np.ndarray, answers: list[pa.Table]) -> np.ndarray:
    """Which words go: those in a window that a document with a smaller id has."""
    n = len(pieces.start)
    depth = np.zeros(n + 1, np.int64)
    if answers:
        answer = pa.concat_tables(answers)
        place = answer.column("place").combine_chunks().to_numpy()
        smallest = answer.column("smallest").combine_chunks()
        values, offsets = smallest.flatten().to_numpy(), smallest.offsets.to_numpy() - smallest.offsets[0].as_py()
        at = np.full(int(kind.max()) + 1, -1)
        at[place] = offsets[:-1]
        hit = np.flatnonzero(at[kind] >= 0)
        length = pieces.length[hit]
        which = np.repeat(hit, length)
        k = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        earlier = values[at[kind[which]] + k] < ids[pieces.doc[which]]
        start = (pieces.first[which] + k)[earlier]
        depth += np.bincount(start, minlength=n + 1) - np.bincount(start + WINDOW, minlength=n + 1)[: n + 1]
    return np.cumsum(depth)[:n] > 0


def _kept(pieces: _Pieces, gone: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """For each document: words, removed words, kept words joined by a space."""
    keep = np.repeat(~gone, pieces.end - pieces.start + 1)
    removed = np.append(0, np.cumsum(gone))
    at = pieces.words.doc_offsets
    edges = np.append(pieces.start, len(pieces.joined))[at]
    for d in range(len(at) - 1):
        r = int(removed[at[d + 1]] - removed[at[d]])
        part = pieces.joined[edges[d] : edges[d + 1]]
        yield int(at[d + 1] - at[d]), r, (part[keep[edges[d] : edges[d + 1]]] if r else part)[:-1].tobytes()


def _frequent(packed: DataFrame, tasks: int) -> tuple[int, np.ndarray]:
    """(buckets, sorted frequent minimisers) of all documents, by one pass that counts the pieces of each batch.

    Batches report a minimiser from half of its share on, so what is frequent overall is reported by those that hold at least half of it.
    """

    def counts(batches):
        for _, table in _unpacked(batches):
            text = table.column("text").combine_chunks()
            mini = _Pieces(text, np.zeros(0, np.uint64)).mini
            values, n = np.unique(mini, return_counts=True)
            keep = n >= max(2, FREQUENT / 2 * len(mini))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(0, values[keep].view(np.int64))), pa.array(np.append(len(mini), n[keep])), pa.array(np.append(text_buffer(text)[1][-1], np.zeros(keep.sum(), np.int64)))], ["mini", "n", "bytes"])

    found = stored(packed.select("batch", "packed").mapInArrow(counts, "mini long, n long, bytes long").groupBy("mini").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")))
    total = found.where("mini = 0").first()
    if total is None:
        return tasks, np.zeros(0, np.uint64)
    buckets = max(tasks, math.ceil(3 * total.bytes / BUCKET_BYTES))
    share = max(FREQUENT, 1 / (4 * buckets))
    rows = found.where((F.col("mini") != 0) & (F.col("n") >= share / 2 * total.n)).select("mini").collect()
    return buckets, np.sort(np.array([r.mini for r in rows], np.int64).view(np.uint64))


def _process(docs: DataFrame, finish, schema: str) -> DataFrame:
    """Runs the exchange and gives finish(rows of a batch, iterator of _kept) to the result; docs has doc_id and text."""
    spark = docs.sparkSession
    prepare_workers(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = stored(docs.mapInArrow(_batched, "batch long, part long, packed binary"))
    buckets, frequent = _frequent(docs, tasks)
    tasks = max(tasks, math.ceil(buckets / TASK_BUCKETS))
    frequent = spark.sparkContext.broadcast(frequent)
    levels = max(1, math.ceil(math.log(buckets, FAN_OUT)))

    def first_level(batches):
        for number, table in _unpacked(batches):
            pieces = _Pieces(table.column("text").combine_chunks(), frequent.value)
            if not len(pieces.first):
                continue
            kind, words = pieces.distinct()
            id_of = _ids(table)[pieces.doc]
            least, most, mini = np.full(len(words), np.iinfo(np.int64).max), np.full(len(words), np.iinfo(np.int64).min), np.zeros(len(words), np.uint64)
            np.minimum.at(least, kind, id_of)
            np.maximum.at(most, kind, id_of)
            mini[kind] = pieces.mini
            # the upper half of a minimiser tells its bucket; pieces that share no more than that only make the bucket compare more of them
            rows = pa.table({"batch": np.full(len(words), number), "place": np.arange(len(words), dtype=np.int32), "mini": (mini >> np.uint64(32)).astype(np.uint32), "words": words, "least": least, "more": most - least})
            yield from _deal(number, rows, 0, levels, buckets)

    def next_level(level):
        def split(batches):
            held, size, number = [], 0, TaskContext.get().partitionId() << 32
            for batch in batches:
                for packed in batch.column("packed"):
                    held.append(_unpack(packed.as_buffer()))
                    size += held[-1].nbytes
                    if size >= 8 * BATCH_BYTES:
                        yield from _deal(number, pa.concat_tables(held), level, levels, buckets)
                        held, size, number = [], 0, number + 1
            if held:
                yield from _deal(number, pa.concat_tables(held), level, levels, buckets)

        return split

    def answers(batches):
        for rows in runs(batches, "bucket", 1):
            bucket = rows.column("bucket").to_numpy()
            bounds = np.append(np.flatnonzero(np.diff(bucket, prepend=-1) != 0), len(bucket)).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                found = _shared_windows(pa.concat_tables(_unpack(x.as_buffer()) for x in rows.column("packed").slice(a, b - a)).combine_chunks())
                if found is not None:
                    batch = found.column("batch").to_numpy()
                    order = np.argsort(batch, kind="stable")
                    found, batch = found.take(pa.array(order)), batch[order]
                    cuts = np.append(np.flatnonzero(np.diff(batch, prepend=-1) != 0), len(batch)).tolist()
                    for c, e in zip(cuts[:-1], cuts[1:], strict=True):
                        yield pa.RecordBatch.from_arrays([pa.array([int(batch[c])], pa.int64()), pa.array([int(bucket[a]) + 1], pa.int64()), pa.array([_pack(found.slice(c, e - c).drop_columns("batch"))], pa.binary())], ["batch", "part", "packed"])

    def apply(batches):
        def done(rows, found):
            pieces = _Pieces(rows.column("text").combine_chunks(), frequent.value)
            kind = pieces.distinct()[0] if found else np.zeros(0, np.int64)
            yield from finish(rows.combine_chunks(), _kept(pieces, _flags(pieces, kind, _ids(rows), found)))

        # part -1 is the documents, the others are the answers to them
        rows, found, now = None, [], None
        for batch in batches:
            for number, part, packed in zip(*(batch.column(c) for c in ("batch", "part", "packed")), strict=True):
                number, part = number.as_py(), part.as_py()
                if number != now:
                    if rows is not None:
                        yield from done(rows, found)
                    rows, found, now = None, [], number
                if part < 0:
                    rows = _unpack(packed.as_buffer())
                else:
                    found.append(_unpack(packed.as_buffer()))
        if rows is not None:
            yield from done(rows, found)

    packed = docs.select("batch", "packed").mapInArrow(first_level, "bucket long, number long, packed binary")
    for level in range(1, levels):
        packed = packed.repartition(tasks, "bucket", F.expr(f"number % {FAN_OUT}")).mapInArrow(next_level(level), "bucket long, number long, packed binary")
    told = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(answers, "batch long, part long, packed binary")
    return docs.unionByName(told).repartition(tasks, "batch").sortWithinPartitions("batch", "part").mapInArrow(apply, schema)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of `docs` (doc_id, text; other columns are ignored).

    Null and empty texts have no words; texts of any length count whole. Rows with one id do not remove each other's words; rows without an id lose what any other document has and
    remove nothing from others. Texts under 13 words stay whole.
    """

    def finish(rows, kept):
        kept = list(kept)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").combine_chunks(), pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[2]).hexdigest() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _process(docs.select(F.col("doc_id").cast("long"), "text"), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with the repeated windows taken out of `text`: kept words joined by one space where words went, else the text as it was.

    A column n_chars is brought up to date; all other columns stay.
    """
    names = docs.columns

    def finish(rows, kept):
        columns = {c: rows.column(c).combine_chunks() for c in names}
        kept = list(kept)
        cut = pa.array([k[1] > 0 for k in kept], pa.bool_())
        text = pa.array([k[2].decode() if k[1] else None for k in kept], pa.string())
        columns["text"] = pc.if_else(cut, text, columns["text"].cast(pa.string()))
        if "n_chars" in columns:
            columns["n_chars"] = pc.if_else(cut, pc.utf8_length(text).cast(columns["n_chars"].type), columns["n_chars"])
        yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return _process(docs, finish, docs.schema)
