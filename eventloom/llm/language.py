"""Language ID: unigram piece probabilities per language over a fixed public vocabulary; a word's score sums over all its segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcols import passes, prepare_workers, stored, text_buffer

#: About FIT_DOCS texts of each of the LANGUAGES most frequent values of lang are learnt from, in ROUNDS rounds of expected counts.
FIT_DOCS, LANGUAGES, ROUNDS = 2000, 500, 4
#: Weight of the piece probabilities of all languages together, in pieces, within those of each.
SMOOTHING = 200.0
#: A run of letters is a word; longer runs count as several words of this many bytes.
WORD_BYTES = 1024
#: Bytes of distinct words that one numpy pass works on.
PASS_WORDS = 1 << 18
#: Expected counts are added as whole numbers of this part of one, so their sums don't depend on the order.
UNIT = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


class Trie(NamedTuple):
    """Pieces by their bytes: `keys` holds node * 256 + byte in order, `child` the node behind it, `piece` the number of the piece that ends at a node, or -1."""

    keys: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    size: int


def vocabulary(path: str) -> list[bytes]:
    """The distinct pieces of a sentencepiece model as bytes, a space for the mark of a word's start, and every single byte, so that all texts have a segmentation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return sorted({model.id_to_piece(i).replace("▁", " ").encode() for i in usual} | {bytes([b]) for b in range(256)})


def trie(pieces: list[bytes]) -> Trie:
    nodes: dict[int, int] = {}
    ends = [-1]
    for number, piece in enumerate(pieces):
        at = 0
        for byte in piece:
            at = nodes.setdefault(at * 256 + byte, len(ends))
            if at == len(ends):
                ends.append(-1)
        ends[at] = number
    keys = np.array(sorted(nodes), np.int64)
    return Trie(keys, np.array([nodes[k] for k in keys.tolist()], np.int64), np.array(ends, np.int64), len(pieces))


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(runs of letters in lower case, how many lie before each text): bytes beyond ASCII count as letters."""
    try:
        column = pc.utf8_lower(column.cast(pa.large_string()))
    except pa.ArrowInvalid:  # not UTF-8
        column = pa.array([None if x is None else x.decode(errors="replace").lower() for x in column.cast(pa.large_binary()).to_pylist()], pa.large_string())
    data, offsets = text_buffer(column)
    letter = _LETTER[data]
    edge = np.empty(len(data), bool)
    edge[:1], edge[1:] = True, ~letter[:-1]
    edge[offsets[(offsets > 0) & (offsets < len(data))]] = True
    starts = np.flatnonzero(letter & edge)
    before = np.append(0, np.cumsum(letter))
    place = np.append(before[starts], before[-1])  # of each run among the letters
    parts = -(-np.diff(place) // WORD_BYTES)
    first = np.append(0, np.cumsum(parts))
    cuts = np.append(np.repeat(place[:-1] - WORD_BYTES * first[:-1], parts) + WORD_BYTES * np.arange(first[-1]), before[-1])
    values = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[letter])])
    return values, first[np.searchsorted(starts, offsets)]


class Lattice:
    """All places where pieces lie in some words, each word behind a space; gaps lie before, between and behind its bytes."""

    def __init__(self, words: pa.Array, trie: Trie) -> None:
        n = len(words)
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
        self.sizes = np.diff(at) + 1
        ends = np.cumsum(self.sizes)
        data = np.full(int(ends[-1]) if n else 0, 32, np.uint8)
        solid = np.ones(len(data), bool)
        solid[ends - self.sizes] = False
        data[solid] = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if n and at[-1] > at[0] else 0
        word = np.repeat(np.arange(n), self.sizes)
        start = active = np.arange(len(data))
        end, node, found = start, np.zeros(len(data), np.int64), []
        while len(active):
            key = node * 256 + data[end]
            i = np.minimum(np.searchsorted(trie.keys, key), len(trie.keys) - 1)
            ok = trie.keys[i] == key
            active, end, node = active[ok], end[ok] + 1, trie.child[i[ok]]
            hit = trie.piece[node] >= 0
            found.append((active[hit], end[hit], trie.piece[node[hit]]))
            on = end < ends[word[active]]
            active, end, node = active[on], end[on], node[on]
        low, high, self.piece = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), (), ())))
        self.word = word[low] if len(low) else low
        self.low, self.high = low + self.word, high + self.word
        self.first = ends - self.sizes + np.arange(n)
        self.last = ends + np.arange(n)
        self.gaps = len(data) + n

    def sums(self, weights: np.ndarray, backward: bool = False) -> np.ndarray:
        """Logarithm, for each gap, of the summed weights of all segmentations up to it (from it on, if backward); a column for each column of `weights`."""
        source, target = (self.high, self.low) if backward else (self.low, self.high)
        origin = (self.last if backward else self.first)[self.word]
        out = np.full((self.gaps, weights.shape[1]), -np.inf)
        out[self.last if backward else self.first] = 0.0
        step = np.abs(target - origin)
        order = np.lexsort((target, step))
        step, source, target, weights = step[order], source[order], target[order], weights[order]
        head = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if len(target) else np.zeros(0, np.int64)
        borders = np.flatnonzero(np.append(True, step[head][1:] != step[head][:-1])) if len(head) else head
        for a, b in zip(borders.tolist(), [*borders[1:].tolist(), len(head)], strict=True):
            low, high = int(head[a]), int(head[b]) if b < len(head) else len(target)
            at = head[a:b] - low
            terms = out[source[low:high]] + weights[low:high]
            most = np.maximum.reduceat(terms, at)
            size = np.diff(np.append(at, high - low))
            out[target[head[a:b]]] = most + np.log(np.add.reduceat(np.exp(terms - np.repeat(most, size, axis=0)), at))
        return out


def chunks(words: pa.Array) -> Iterator[pa.Array]:
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    low = 0
    while low < len(words):
        high = max(low + 1, int(np.searchsorted(at, at[low] + PASS_WORDS, side="right")) - 1)
        yield words.slice(low, high - low)
        low = high


def word_scores(words: pa.Array, trie: Trie, logs: np.ndarray) -> np.ndarray:
    """Log-probability of each word under each language (a row of `logs`), over all its segmentations."""
    found = [lattice.sums(logs.T[lattice.piece])[lattice.last] for lattice in (Lattice(c, trie) for c in chunks(words))]
    return np.concatenate(found) if found else np.zeros((0, len(logs)))


def expected_counts(words: pa.Array, language: np.ndarray, n: np.ndarray, trie: Trie, logs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in n copies of words of given languages, in UNITs: a row for each language."""
    out, low = np.zeros(logs.shape, np.int64), 0
    for part in chunks(words):
        lattice, own = Lattice(part, trie), language[low : low + len(part)]
        weights = logs[own[lattice.word], lattice.piece][:, None]
        before, behind = lattice.sums(weights), lattice.sums(weights, backward=True)
        share = np.exp(before[lattice.low] + weights + behind[lattice.high] - before[lattice.last][lattice.word])[:, 0]
        np.add.at(out, (own[lattice.word], lattice.piece), np.rint(share * n[low : low + len(part)][lattice.word] * UNIT).astype(np.int64))
        low += len(part)
    return out


def probabilities(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Logarithms of piece probabilities from expected counts: each language leans on all of them together, and these on equal shares."""
    pooled = counts.sum(axis=0) + 1.0 / counts.shape[1]
    pooled /= pooled.sum()
    return np.log((counts + smoothing * pooled) / (counts.sum(axis=1, keepdims=True) + smoothing))


def _remainder(n: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


class Model(NamedTuple):
    languages: list[str]
    trie: Trie
    logs: np.ndarray


def fit(docs: DataFrame, path: str, fit_docs: int = FIT_DOCS, rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> Model:
    """Piece probabilities of each lang of `docs` (doc_id, text, lang) by expectation-maximisation, from equal ones.

    Of each language the texts with the smallest hashes are taken, about fit_docs of them, whole; equal rows count once. Their words are counted
    once per language, and every round adds expected counts over these. Only a number per language and piece reaches the driver.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages, lattice = sorted(sizes), trie(vocabulary(path))
    if not languages:
        return Model([], lattice, np.zeros((0, lattice.size)))
    rates = spark.createDataFrame([(x, i, min(1.0, fit_docs / sizes[x])) for i, x in enumerate(languages)], "lang string, language int, rate double")
    place = (F.col("h").cast("double") / 2.0**64) + 0.5
    chosen = known.join(F.broadcast(rates), "lang").where(place <= F.col("rate")).select("language", "h", "text").dropDuplicates(["language", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                words, offsets = words_of(part.column("text"))
                language = np.repeat(part.column("language").to_numpy(), np.diff(offsets))
                table = pa.table({"language": pa.array(language, pa.int32()), "word": words.cast(pa.binary())}).group_by(["language", "word"]).aggregate([([], "count_all")])
                yield from table.rename_columns(["language", "word", "n"]).to_batches()

    words = stored(chosen.mapInArrow(count, "language int, word binary, n long").groupBy("language", "word").agg(F.sum("n").alias("n")))
    logs = np.full((len(languages), lattice.size), -np.log(lattice.size))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((lattice, logs))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = shared.value
            total = np.zeros(now.shape, np.int64)
            for b in batches:
                total += expected_counts(b.column("word").cast(pa.large_binary()), b.column("language").to_numpy(), b.column("n").to_numpy(), own, now)
            at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], ["language", "piece", "n"])

        counts = np.zeros(logs.shape)
        sums = words.mapInArrow(expect, "language int, piece int, n long").groupBy("language", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts[sums["language"].to_numpy(), sums["piece"].to_numpy()] = sums["n"].to_numpy() / UNIT
        logs = probabilities(counts, smoothing)
    return Model(languages, lattice, logs)


def _has_letter(column: pa.Array) -> np.ndarray:
    """Which texts hold a letter of any script."""
    data, offsets = text_buffer(column)
    plain = np.append(0, np.cumsum(_LETTER[data] & (data < 0x80)))[offsets]
    wide = np.append(0, np.cumsum(data >= 0x80))[offsets]
    out = np.diff(plain) > 0
    for i in np.flatnonzero(~out & (np.diff(wide) > 0)).tolist():
        out[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode(errors="replace")))
    return out


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row of `docs` (doc_id, text): the language under which the whole text is likeliest, and its share
    of the summed likelihoods (all languages count alike beforehand; of equal ones the first by name).

    Texts that are null or hold no letter, and all texts where nothing was learnt, get `und` and 0. Texts of any length are scored whole, each
    repeated row gets its row, and other columns are ignored.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, own, logs = shared.value
        names = np.array([*languages, "und"], object)
        for batch in batches:
            for part in passes(batch):
                column = part.column("text")
                letters = _has_letter(column) if languages else np.zeros(part.num_rows, bool)
                best, score = np.full(part.num_rows, len(languages)), np.zeros(part.num_rows)
                if letters.any():
                    words, offsets = words_of(column)
                    coded = words.dictionary_encode()
                    scores, at = word_scores(coded.dictionary, own, logs), coded.indices.to_numpy()
                    doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                    total = np.stack([np.bincount(doc, scores[at, k], part.num_rows) for k in range(len(languages))], axis=1)
                    top = total.max(axis=1)
                    best = np.where(letters, total.argmax(axis=1), best)
                    score = np.where(letters, 1.0 / np.exp(total - top[:, None]).sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, lang_pred string, score double")


def language(docs: DataFrame, path: str, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of `docs` (doc_id, text, lang), learnt from rows of the other folds alone.

    A row is held out if crc32 of its doc_id as text (null: empty) leaves no remainder by `folds`.
    """
    out = identified(docs, fit(docs.where(_remainder(folds) != 0), path))
    return out.select("doc_id", (_remainder(folds) == 0).alias("held_out"), "lang_pred", "score")
