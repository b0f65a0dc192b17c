"""A corpus pipeline over `documents`: toxic documents go, near and exact copies go, repeated passages go, personal data is masked, texts are packed.

Each stage reads what its predecessor wrote and decides on its own input. STAGES lists them; all but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import packing, pii, simhash, substrings, toxicity
from eventloom.llm.textcols import WRITTEN, release, stored

_SCORE = "__toxicity"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the classifier is fitted on labelled rows of the training folds."""
    weights = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out())
    return toxicity.with_scores(docs, weights, _SCORE).where(f"{_SCORE} < {toxicity.THRESHOLD}").drop(_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by SimHash (five-word shingles) and a Jaccard similarity of 0.8 and more."""
    return simhash.deduplicated(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that a document with a smaller id has."""
    return substrings.without_repeats(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 2048 tokens."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("substring_dedup", drop_repeated_passages), ("pii", mask_personal_data), ("packing", pack)]

#: SQL cannot express the classifier, the fingerprints' hash and the tokenizer; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what only earlier stages needed is deleted there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        before = len(WRITTEN)
        docs = stored(stage(spark, docs, sf_dir))
        *made, own = WRITTEN[before:]
        release(spark, [*made, *last])
        last = [own]
    return docs
