"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcols import WRITTEN, Words, passes, prepare_workers, release, split_words, stored, text_buffer

#: Hashed feature space: 2 ** BITS coordinates, so weights never exceed 2 MB.
BITS = 18
#: Documents are called toxic from this score on.
THRESHOLD = 0.7
#: The classifier is fitted on at most this many labelled documents, those with the smallest hash of doc_id, and of these in that order on as
#: many as have this many coordinates together.
FIT_ROWS, FIT_COORDS = 16_000, 32_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 10.0, 0.2

#: A-Z to lower case; ASCII signs separate words.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def _tokens(column: pa.Array) -> Words:
    data, offsets = text_buffer(column)
    return split_words(_FOLD[data], offsets)


def _features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, coordinate) of every unigram, bigram and one-word skip-gram."""
    coded = words.values.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy()]
    doc = words.doc_of
    docs, coords = [doc], [h]
    for step, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[:-step] == doc[step:]
        docs.append(doc[:-step][same])
        coords.append(((h[:-step] ^ np.uint64(salt)) * np.uint64(0xFF51AFD7ED558CCD) + h[step:])[same] * np.uint64(0x9FB21C651E98DF25))
    # coordinate 0 stays free for the bias
    return np.concatenate(docs), np.maximum(np.concatenate(coords) >> np.uint64(64 - BITS), 1).astype(np.int32)


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in passes(batch):
            doc, coord = _features(_tokens(part.column("text")))
            pairs = np.unique(doc.astype(np.int64) << 32 | coord)
            bounds = np.searchsorted(pairs >> 32, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(bounds, (pairs & 0xFFFFFFFF).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("place"), part.column("label"), lists], ["place", "label", "coords"])


def ftrl(rows: list[tuple[int, np.ndarray]]) -> dict[int, float]:
    """Weights after EPOCHS passes over (label, coordinates) rows: each coordinate has its own learning rate, and L1 leaves most at zero."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    l1 = np.full(1 << BITS, L1)
    l1[0] = 0

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1[i], 0.0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, coords in rows:
            i = np.append(coords, 0)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    every = np.arange(1 << BITS)
    w = weights(every)
    return {int(i): float(w[i]) for i in every[w != 0]}


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [(p, y, np.asarray(c.values)) for b in batches for p, y, c in zip(b.column("place").to_pylist(), b.column("label").to_pylist(), b.column("coords"), strict=True)]
    w = ftrl([(y, c) for _, y, c in sorted(rows, key=lambda r: r[0])]) if len({y for _, y, _ in rows}) == 2 else {}
    yield pa.RecordBatch.from_arrays([pa.array(list(w), pa.int32()), pa.array(list(w.values()), pa.float64())], ["coord", "weight"])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = FIT_ROWS) -> dict[int, float]:
    """Sparse weights learnt from at most `rows` labelled documents (columns doc_id, toxic of `labels`; `usable` restricts them).

    A document with several labels counts as toxic if one says so, and of several texts with one id the one with the smallest hash is learnt from,
    so repeated rows change nothing; null labels are ignored; unless there are labels of both kinds, there are no weights, and every score is 0.5.
    `rows` bounds what is broadcast, and FIT_COORDS with it what the one fitting task holds.
    """
    prepare_workers(docs.sparkSession)
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = chosen if usable is None else chosen.where(usable)
    chosen = chosen.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).withColumn("hash", F.xxhash64("doc_id")).orderBy("hash", "doc_id").limit(rows)
    # places without ties, in the order that is learnt in
    placed = [(r.doc_id, r.label, k) for k, r in enumerate(sorted(chosen.collect(), key=lambda r: (r["hash"], r.doc_id)))]
    id_type = labels.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(placed, f"doc_id {id_type}, label int, place long")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("place", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    coords = stored(texts.mapInArrow(_fit_rows, "place long, label int, coords array<int>"))
    total, last = 0, -1
    for r in sorted(coords.select("place", F.size("coords").alias("n")).collect()):  # at most `rows` numbers
        total += r.n
        if total > FIT_COORDS:
            break
        last = r.place
    weights = {r.coord: r.weight for r in coords.where(F.col("place") <= last).repartition(1).mapInArrow(_fit, "coord int, weight double").collect()}
    release(docs.sparkSession, WRITTEN[-1:])
    return weights


def scorer(spark: SparkSession, weights: dict[int, float]) -> Callable[[pa.Array], np.ndarray]:
    """A function from a text column to scores; the weights travel as one broadcast of at most 2 ** BITS doubles."""
    prepare_workers(spark)
    dense = np.zeros(1 << BITS)
    dense[list(weights)] = list(weights.values())
    sent = spark.sparkContext.broadcast(dense)

    def score(column: pa.Array) -> np.ndarray:
        w = sent.value
        doc, coord = _features(_tokens(column))
        live = w[coord] != 0
        pairs = np.unique(doc[live].astype(np.int64) << 32 | coord[live])
        margin = w[0] + np.bincount(pairs >> 32, w[pairs & 0xFFFFFFFF], len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))

    return score


def with_scores(docs: DataFrame, weights: dict[int, float], into: str = "toxicity") -> DataFrame:
    """`docs` (any columns, among them text) with the score of each whole text in column `into`. Null and empty texts get the bias's score."""
    score = scorer(docs.sparkSession, weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(part.column("text")))], [*part.schema.names, into])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def held_out(doc_id: Column | None = None) -> Column:
    """True for the third of the documents whose labels are never read."""
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs` (doc_id, text).

    Texts of any length are scored whole, null and empty ones get the bias's score; repeated rows are scored alike, extra columns are ignored, and
    a row without an id is not held out.
    """
    weights = fit(docs, labels, ~held_out())
    scored = with_scores(docs.select("doc_id", "text"), weights, "score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
